"""Documents made of postings: nested export, Markdown rows, chat chunks, mail text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import escape_html
from boardwright.operators.report import ordered_index

FIELDS = ("title", "link", "apply_link", "pdf_link", "date", "date_iso", "tier")


def export_orgs(postings: DataFrame, orgs: DataFrame, outcomes: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """(per, org_key, name, url, status, category, jobs): one document per org, and for each ``per``, postings by pos. Missing fields become ''.

    The document of one org is one value by definition, as long as its postings are.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    jobs = postings.select(*per, "org_key", "pos", *[text(c) for c in FIELDS])
    nested = jobs.groupBy(*per, "org_key").agg(F.array_sort(F.collect_list(F.struct("pos", *FIELDS))).alias("j"))
    nested = nested.select(*per, "org_key", F.transform("j", lambda x: F.struct(*[x[c].alias(c) for c in FIELDS])).alias("jobs"))
    status = outcomes.groupBy(*per, "org_key").agg(F.max_by("status", "run_id").alias("status"))
    known = orgs.groupBy("org_key").agg(F.min("name").alias("name"), F.min("url").alias("url"), F.min("category").alias("category"))
    both = status.join(known, "org_key", "left").join(nested, [*per, "org_key"], "left")
    return both.select(
        *per, "org_key", F.coalesce("name", F.upper("org_key")).alias("name"), text("url"), "status", F.coalesce("category", F.lit("other")).alias("category"),
        F.coalesce("jobs", F.expr("cast(array() as array<struct<title:string,link:string,apply_link:string,pdf_link:string,date:string,date_iso:string,tier:string>>)")).alias("jobs"),
    )


def write_export(documents: DataFrame, path: str) -> None:
    """The org documents as JSON lines, one file per partition."""
    documents.write.mode("overwrite").json(path)


def markdown_rows(postings: DataFrame, orgs: DataFrame, tie: str) -> DataFrame:
    """(idx, line): table rows of relevant postings, by org name and title in lower case, then ``tie``; no date is '-'."""
    names = orgs.groupBy("org_key").agg(F.min("name").alias("name"))
    rows = postings.filter("relevance = 'relevant'").join(names, "org_key", "left")
    org = F.coalesce("name", F.upper("org_key"))
    ready = rows.select(org.alias("org"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("link", F.lit("")).alias("link"), F.coalesce(F.nullif("date", F.lit("")), F.lit("-")).alias("date"), tie)
    indexed = ordered_index(ready, [F.lower("org"), F.lower("title"), F.col(tie)])
    cell = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("idx").cast("string"), cell("org"), F.concat(F.lit("["), cell("title"), F.lit("]("), "link", F.lit(")")), "date"), F.lit(" |"))
    return indexed.select("idx", tie, line.alias("line"))


#: Most characters of a chat message.
CHUNK = 1900


class Chunker:
    """Messages of one channel: a line opens a new message when it and its header no longer fit.

    The header comes again before every line while the message doesn't begin with it.
    """

    def __init__(self, limit: int = CHUNK, intro: str = "New postings\n"):
        self.limit, self.text, self.number = limit, intro, 0

    def add(self, name: str, title: str, link: str) -> list[tuple[int, str]]:
        """The messages that this line completes."""
        head, line, done = f"**{name}**\n", f"- {title} {link}\n", []
        section = "" if self.text.startswith(head) else head
        if self.text and len(self.text) + len(section) + len(line) > self.limit:
            done = self.end()
            section = head
        self.text += section + line
        return done

    def end(self) -> list[tuple[int, str]]:
        done = [(self.number, self.text)] if self.text else []
        self.number, self.text = self.number + 1, ""
        return done


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    channel, chunker = None, None
    names = ["channel", "chunk_no", "text"]

    def rows(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([channel] * len(done), pa.string()), pa.array([n for n, _ in done], pa.int32()), pa.array([t for _, t in done], pa.string())], names)

    for b in batches:
        for c, *line in zip(*(b.column(x).to_pylist() for x in ("channel", "name", "title", "link"))):
            if chunker is None or c != channel:
                if chunker:
                    yield rows(chunker.end())
                channel, chunker = c, Chunker()
            if done := chunker.add(*(x or "" for x in line)):
                yield rows(done)
    if chunker:
        yield rows(chunker.end())


def chat_chunks(alerts: DataFrame) -> DataFrame:
    """(channel, chunk_no, text) of alerts (channel, ord, name, title, link).

    A fold per channel over its sorted alerts, whose state is the message under way: rows stream through the task that
    has the channel, they aren't gathered.
    """
    placed = alerts.select("channel", "ord", "name", "title", "link").repartition("channel").sortWithinPartitions("channel", "ord")
    return placed.mapInArrow(_chunks, "channel string, chunk_no int, text string")


def mail_sections(postings: DataFrame, orgs: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """(per, org_key, body, html): text and HTML list of an org's postings by pos, for each ``per`` (a mail); uncertain ones carry a warning."""
    mark = F.when(F.col("relevance") == "uncertain", "[check] ").otherwise("")
    title, link = F.coalesce("title", F.lit("")), F.coalesce("link", F.lit(""))
    item = F.struct("pos", F.concat(mark, title, F.lit(" - "), link).alias("t"), F.concat(F.lit("<li>"), mark, escape_html(title), F.lit("</li>")).alias("h"))
    rows = postings.filter("relevance != 'excluded'").groupBy(*per, "org_key").agg(F.array_sort(F.collect_list(item)).alias("i"))
    names = orgs.groupBy("org_key").agg(F.min("name").alias("name"))
    both = rows.join(names, "org_key", "left").withColumn("n", F.coalesce("name", F.upper("org_key")))
    return both.select(*per, "org_key", F.concat_ws("\n", F.col("n"), F.transform("i", lambda x: x["t"])).alias("body"), F.concat(F.lit("<h3>"), escape_html(F.col("n")), F.lit("</h3><ul>"), F.concat_ws("", F.transform("i", lambda x: x["h"])), F.lit("</ul>")).alias("html"))


def log_tail(lines: DataFrame, n: int = 100, seq: str = "seq") -> DataFrame:
    """The last n lines, a top-k by sequence."""
    return lines.orderBy(F.desc(seq)).limit(n).orderBy(seq)
