"""Cross-domain filter and the order-dependent merge of postings."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import host, is_pdf_link, strip, title_key, url_key
from boardwright.operators.components import components

#: Suffixes that make the last three, or the last two, labels of a host a domain of its own.
THREE_LABELS = (".gov.in", ".nic.in", ".edu.in", ".ac.in", ".co.in", ".org.in", ".res.in")
TWO_LABELS = (".edu", ".org", ".com", ".net", ".in")


def allowed_domains(url: Column) -> Column:
    """The host of a site and the domains derived from it by its suffix ('x.gov.in' also allows 'gov.in')."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    three = F.when(h.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in THREE_LABELS) + ")$"), F.substring_index(h, ".", -3))
    two = F.when(h.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in TWO_LABELS) + ")$"), F.substring_index(h, ".", -2))
    return F.array_distinct(F.filter(F.array(h, three, two), lambda d: d.isNotNull() & (d != "")))


def allow_links(postings: DataFrame, orgs: DataFrame, everywhere: tuple[str, ...] = ()) -> DataFrame:
    """Postings whose link is relative, on an allowed domain of their org, or on a domain allowed everywhere.

    Empty and null links are dropped; so are absolute links of orgs that the registry doesn't list, unless
    allowed everywhere. The registry is joined by key, whatever its size.
    """
    allowed = orgs.groupBy("org_key").agg(F.flatten(F.collect_set(allowed_domains(F.col("url")))).alias("_allowed"))
    rows = postings.join(allowed, "org_key", "left").withColumn("_host", host(F.col("link")))
    domains = F.concat(F.coalesce("_allowed", F.array().cast("array<string>")), F.array(*[F.lit(d) for d in everywhere]).cast("array<string>"))
    on = F.exists(domains, lambda d: (F.col("_host") == d) | F.col("_host").endswith(F.concat(F.lit("."), d)))
    kept = rows.filter(F.trim("link") != "").filter((F.col("_host") == "") | on)
    return kept.drop("_allowed", "_host")


#: Titles that never identify a posting.
GENERIC_KEYS = ("notification", "recruitment", "careers", "jobs", "vacancy", "advertisement", "click here", "view", "details", "heading")
#: Most rows that one scan may hold before an org's rows are split into independent parts.
SCAN_ROWS = 200_000
_RANK = {"relevant": 2, "uncertain": 1, "excluded": 0}
MERGED = "org_key string, group_pos long, title string, link string, apply_link string, pdf_link string, date string, relevance string, members long"


class Scan:
    """The groups of one scan: each posting joins the first group that it fits, or begins one."""

    def __init__(self):
        self.groups: list[dict] = []
        self.by_url: dict[str, int] = {}
        self.lacking: dict[tuple[str, str], deque[int]] = {}  # groups of a title that lack a link of a kind, in order; filled ones go when met

    def add(self, pos: int, title: str, link: str, date: str, relevance: str, title_key: str, url: str, is_pdf: bool) -> None:
        slot = "pdf" if is_pdf else "apply"
        fits = [self.by_url[url]] if url in self.by_url else []
        named = len(title_key) > 8 and title_key not in GENERIC_KEYS
        if named:
            waiting = self.lacking.setdefault((title_key, slot), deque())
            while waiting and self.groups[waiting[0]][slot]:
                waiting.popleft()
            fits += waiting and [waiting[0]]
        if not fits:
            at = len(self.groups)
            self.groups.append({"pos": pos, "title": title, "date": date, "relevance": relevance, "apply": "", "pdf": "", "members": 1})
            if named:
                for kind in ("apply", "pdf"):
                    self.lacking.setdefault((title_key, kind), deque()).append(at)
        else:
            at = min(fits)
            g = self.groups[at]
            g["date"] = g["date"] or date
            g["relevance"] = max(g["relevance"], relevance, key=lambda r: _RANK.get(r, 0))
            g["members"] += 1
        if not self.groups[at][slot]:
            self.groups[at][slot] = link
            if url:
                self.by_url[url] = min(at, self.by_url.get(url, at))

    def rows(self, key: str) -> list[tuple]:
        return [(key, g["pos"], g["title"], g["apply"] or g["pdf"], g["apply"], g["pdf"], g["date"], g["relevance"], g["members"]) for g in self.groups]


def _scans(by: list[str], with_run: bool):
    """Scans one after the other over rows that are sorted by ``by`` and pos."""
    names = (["run"] if with_run else []) + [f.split(" ")[0] for f in MERGED.split(", ")]
    kinds = ([pa.int64()] if with_run else []) + [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64()]
    fields = ("pos", "title", "link", "date", "relevance", "title_key", "url", "is_pdf")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scan, out = None, None, []
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in by))
            for k, r in zip(keys, zip(*(b.column(c).to_pylist() for c in fields))):
                if k != key:
                    if scan:
                        out += ended(key, scan)
                    key, scan = k, Scan()
                scan.add(*r)
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if scan:
            out += ended(key, scan)
        yield batch(out)

    def ended(key: tuple, scan: Scan) -> list[tuple]:
        named = dict(zip(by, key))
        lead = (named["_run"],) if with_run else ()
        return [lead + r for r in scan.rows(named["org_key"])]

    return run


def merge_postings(postings: DataFrame, run: str | None = None, key: Column | None = None) -> DataFrame:
    """Merged postings, in the order of ``pos``; by org, or by org and run.

    A posting joins the first group whose apply or PDF link it has, or whose title it has (not a generic one, longer
    than eight characters) if the group lacks a link of its kind. Not transitive, so no connected components. The
    scan is sequential by definition. Where an org (or run of one) has more than SCAN_ROWS rows, it is cut first into
    parts that can't touch one another, with the same result.
    Null fields count as '', titles and links are stripped; rows without an org and without a title take no part.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    postings = postings.withColumns({"title": strip(F.col("title")), "link": strip(F.col("link"))}).filter("title != ''")
    rows = postings.filter("org_key is not null").select(
        *([F.col(run).cast("long").alias("_run")] if run else []), "org_key", "pos", text("title"), text("link"), text("date"), text("relevance"),
    )
    link = F.coalesce(F.col("link"), F.lit(""))
    rows = rows.select("*", title_key(F.col("title")).alias("title_key"), (url_key(link) if key is None else key).alias("url"), is_pdf_link(link).alias("is_pdf"))
    by = (["_run"] if run else []) + ["org_key"]
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most > SCAN_ROWS:
        rows, by = split_scans(rows, by), [*by, "part"]
    placed = rows.repartition(*by).sortWithinPartitions(*by, "pos")
    return placed.mapInArrow(_scans(by, bool(run)), ("run long, " if run else "") + MERGED)


def split_scans(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with a column part: postings that share no URL and no title, not even over others, never meet in a scan.

    The parts are the connected components of URL and title hashes, so each can be scanned alone with the same result.
    """
    title, url = F.xxhash64(F.lit("t"), *by, "title_key"), F.xxhash64(F.lit("u"), *by, "url")
    marked = rows.withColumn("_t", title).withColumn("_u", F.when(F.col("url") != "", url).otherwise(title))
    labels = components(marked.select(F.col("_t").alias("a"), F.col("_u").alias("b"))).toDF("_t", "_label")
    return marked.join(labels, "_t", "left").withColumn("part", F.coalesce("_label", "_t")).drop("_t", "_u", "_label")
