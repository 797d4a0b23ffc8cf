"""New batches against all history: a persisted index of blocking keys, probed and appended to, never rebuilt.

The index is a folder of tables cut into parts by a hash of their key: pigeonhole blocks, one row each; the words of
nodes (word set and form), each where the task that met it wrote it; the rows of each node that a link is compared
by; exact forms; the word order that was fixed when the index was made; and the mapping of clusters. A probe reads only the parts that the batch's keys fall
in, drops rows that a bitmap of these keys doesn't hold, joins the rest on blocks and checks the words. A part has a
fixed size when the index is made, so a batch of k keys reads at most k parts, however long the history.

Links are scored by the Fellegi-Sunter model, whose weights EM learns from the counts of comparison patterns; each
pattern that a row of an earlier title makes is scored, by the least such row, and each known row is linked to its
best match.

Clusters (rows of alike titles or equal forms, and what they connect) are kept as a union-find forest in two tables:
the representative that a vertex got when it came, and merges of representatives. A batch reads the vertices that it
touches, follows the merges to their roots, unites roots and new vertices, and appends what is new: new vertices,
and one merge for each root that lost its place. Clusters that it doesn't touch are neither read nor written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright.functions.text import link_form, title_form
from boardwright.llm import bitmaps
from boardwright.llm.blocking import LEAST_WORDS, MEETS_LONG, ORDER_SLOTS, SHORT, blocks, close, node_id, slot_counts, split_join, titled, word_hashes
from boardwright.llm.copies import canonical
from boardwright.llm.neardups import alike_nodes, checked, nodes_of
from boardwright.operators.components import components
from boardwright.session import materialize

#: Rows of history that one part of each table is for, and the files that a part may be spread over.
PART_ROWS, PART_FILES = 1 << 17, 4
#: The batch number of rows that the index was made of; those of batches are not negative.
HISTORY = -1
_REF = "ref struct<batch: int, id: long>"
_TABLES = {
    "blocks": "key long, nid long, fp int, size int, skips int, home long", "forms": "h1 long, h2 long", "rows": f"nid long, {_REF}, link long, day long",
    "days": f"h1 long, h2 long, {_REF}, day long", "members": f"vertex long, {_REF}", "merges": f"{_REF}, into struct<batch: int, id: long>",
}
_WORDS = "nid long, fh long, ws array<long>, home long"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each first column's value once in a batch: a hot value is one row in some thousands before it is shuffled."""
    for b in batches:
        _, first = np.unique(b.column(0).to_numpy(), return_index=True)
        yield b.take(pa.array(first))


def _day() -> Column:
    return F.xxhash64(F.coalesce("date", F.lit("")))


def described(rows: DataFrame) -> DataFrame:
    """(ref, nid, fh, ws, h1, h2, link, day) of rows (ref, title, link, date).

    nid and ws are null for titles of fewer than six words, h1 and h2 for rows without title form or link form; rows
    with neither, which can match nothing, are left out.
    """
    form = F.explode(F.array(F.struct(title_form(F.col("title")).alias("t"), link_form(F.col("link")).alias("l")))).alias("f")  # generators: worked out once
    base = rows.select("ref", F.coalesce("title", F.lit("")).alias("title"), form, _day().alias("day")).select("ref", "f", "day", word_hashes(F.col("title")).alias("ws"))
    whole, worded = (F.col("f.t") != "") & (F.col("f.l") != ""), F.size("ws") >= LEAST_WORDS
    out = base.select(
        "ref", F.xxhash64("f.t").alias("fh"), F.when(worded, F.col("ws")).alias("ws"), F.when(whole, F.xxhash64("f.t", "f.l")).alias("h1"),
        F.when(whole, F.xxhash64("f.l", F.lit("|"), "f.t")).alias("h2"), F.xxhash64("f.l").alias("link"), "day",
    )
    return out.select("ref", F.when(F.col("ws").isNotNull(), node_id()).alias("nid"), "fh", "ws", "h1", "h2", "link", "day").filter("nid is not null or h1 is not null")


class LinkageIndex:
    """Index of accepted rows at a path that outlives the call; ``create`` once, then ``append`` each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        order = spark.read.parquet(f"{path}/order").collect()  # ORDER_SLOTS rows, and one for each of two settings
        self.counts, settings = np.zeros(ORDER_SLOTS, np.int64), {}
        for r in order:
            if r.slot < 0:
                settings[r.slot] = r.n
            else:
                self.counts[r.slot] = r.n
        self.total = max(int(self.counts.sum()) // 10, 2)
        self.parts, self.linked = settings[-1], bool(settings[-2])

    @classmethod
    def create(cls, history: DataFrame, path: str, key: str = "job_id", links: bool = False, part_rows: int = PART_ROWS) -> LinkageIndex:
        """An index of history (key, title, link, date). links: with the rows and the mapping that ``links`` and ``clusters`` of a probe need."""
        spark = history.sparkSession
        rows = _referred(history, key, F.lit(HISTORY))
        words = _write_words(rows, path)
        counts, _ = slot_counts(words)
        parts = max(1, -(-history.count() // part_rows))
        settings = [(i, int(n)) for i, n in enumerate(counts.tolist())] + [(-1, parts), (-2, int(links))]
        spark.createDataFrame(settings, "slot int, n long").coalesce(1).write.parquet(f"{path}/order")
        index = cls(spark, path)
        index._add(rows, words)
        if links:
            known = materialize(described(rows), "described")
            index._add_rows(known)
            index._write(_clusters_of(known), "members", "vertex")
            index._write(spark.createDataFrame([], _TABLES["merges"]), "merges", "ref")
        return index

    def append(self, rows: DataFrame, key: str, batch: str) -> None:
        """Accept a batch; its clusters, where the index keeps them, are those of a probe of it."""
        rows = _referred(rows, key, F.coalesce(batch, F.lit(0)))
        if self.linked:
            known = materialize(described(rows), "described")
            Probe(self, known, key, batch, described_already=True).clusters()
            self._add_rows(known)
        self._add(rows, _write_words(rows, self.path))

    def _add(self, rows: DataFrame, words: DataFrame) -> None:
        self._write(blocks(words, self.counts, self.total, SHORT + 1, home=True), "blocks", "key")
        forms = canonical(rows, "ref", F.col("title"), F.col("link")).select("h1", "h2")
        self._write(forms.mapInArrow(_once, "h1 long, h2 long"), "forms", "h1")

    def _add_rows(self, known: DataFrame) -> None:
        least = lambda d, *by: d.groupBy(*by).agg(F.min("ref").alias("ref"))
        self._write(least(known.filter("nid is not null"), "nid", "link", "day"), "rows", "nid")
        self._write(least(known.filter("h1 is not null"), "h1", "h2", "day"), "days", "h1")

    def _part(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, table: str, by: str) -> None:
        """Append; a part goes to PART_FILES tasks at most, so that a hot key of it isn't one task's."""
        placed = rows.withColumn("part", self._part(by)).repartition("part", F.pmod(F.xxhash64(*rows.columns), F.lit(PART_FILES)))
        placed.sortWithinPartitions("part", by).write.mode("append").partitionBy("part").parquet(f"{self.path}/{table}")

    def _parts_of(self, table: str, keys: DataFrame, by: str) -> DataFrame:
        parts = [r.part for r in keys.select(self._part(by).alias("part")).distinct().collect()]  # at most the index's parts
        there = self.spark.read.schema(f"{_TABLES[table]}, part int").parquet(f"{self.path}/{table}")
        return there.filter(F.col("part").isin(parts)).drop("part")

    def read(self, table: str, column: str, keys: DataFrame, by: str) -> DataFrame:
        """Rows of a table whose column is among ``by`` of keys (and a few others), from the parts of these keys alone."""
        return bitmaps.keep(self._parts_of(table, keys, by), column, keys, by)

    def merges(self, refs: DataFrame) -> DataFrame:
        """(ref, into) of the representatives in refs that have been merged into another."""
        return self._parts_of("merges", refs, "ref").join(refs, "ref", "left_semi")

    def words(self, found: DataFrame) -> DataFrame:
        """(nid, fh, ws) of found (nid, home), from the homes named there."""
        homes = [r.home for r in found.select("home").distinct().collect()]  # at most one for each task that wrote words
        there = self.spark.read.schema(_WORDS).parquet(f"{self.path}/words").filter(F.col("home").isin(homes))
        return nodes_of(bitmaps.keep(there.drop("home"), "nid", found, "nid"))

    def long_blocks(self, keys: DataFrame) -> DataFrame:
        """The long blocks, of those in keys, of nodes that the index holds short blocks of only: asked for by titles longer than SHORT."""
        words = self.spark.read.schema(_WORDS).parquet(f"{self.path}/words").filter(F.size("ws").between(MEETS_LONG, SHORT))
        return bitmaps.keep(blocks(words, self.counts, self.total, MEETS_LONG, short=False, home=True), "key", keys, "key")


def _write_words(rows: DataFrame, path: str) -> DataFrame:
    """Append the nodes of rows where they lie, without a shuffle: each task's are one home. Returns those of these rows."""
    base = uuid.uuid4().int >> 88 << 22  # homes of one call lie together; two calls with the same numbers do no harm
    made = titled(rows, "ref").select("nid", "fh", "ws").mapInArrow(_once, "nid long, fh long, ws array<long>")
    made.withColumn("home", F.spark_partition_id() + F.lit(base)).write.mode("append").partitionBy("home").parquet(f"{path}/words")
    return rows.sparkSession.read.schema(_WORDS).parquet(f"{path}/words").filter(F.col("home").between(base, base + (1 << 22) - 1))


def _referred(rows: DataFrame, key: str, batch: Column) -> DataFrame:
    return rows.select(F.struct(batch.cast("int").alias("batch"), F.col(key).cast("long").alias("id")).alias("ref"), "title", "link", "date")


def _edges_of_rows(known: DataFrame) -> DataFrame:
    """(a, b): a row's node and its form are one cluster."""
    return known.filter("nid is not null and h1 is not null").select(F.col("nid").alias("a"), F.col("h1").alias("b")).distinct()


def _firsts(known: DataFrame) -> DataFrame:
    """(vertex, first): nodes and forms of rows, with their least row."""
    vertices = known.select("ref", F.explode(F.array("nid", "h1")).alias("vertex")).filter("vertex is not null")
    return vertices.groupBy("vertex").agg(F.min("ref").alias("first"))


def _clusters_of(known: DataFrame) -> DataFrame:
    """(vertex, ref) of each vertex, with the least row of its cluster."""
    firsts = materialize(_firsts(known), "vertices")
    titles = known.filter("ws is not null").select("nid", "fh", "ws")
    labels = components(_edges_of_rows(known).unionByName(alike_nodes(titles)).distinct()).toDF("vertex", "label")
    named = materialize(firsts.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex")), "labels")
    return named.join(named.groupBy("label").agg(F.min("first").alias("ref")), "label").select("vertex", "ref")


class Probe:
    """A batch, or several in their order, held against an index and against its own earlier rows."""

    def __init__(self, index: LinkageIndex, rows: DataFrame, key: str, batch: str, described_already: bool = False):
        self.index, self.key = index, key
        self.known_rows = rows if described_already else materialize(described(_referred(rows, key, F.coalesce(batch, F.lit(0)))), "batch")
        self.titled = self.known_rows.filter("nid is not null")
        # a node's rows are combined in each task; one node stays
        self.nodes = materialize(self.titled.groupBy("nid").agg(F.min("ref").alias("first"), F.first(F.struct("fh", "ws")).alias("v")).select("nid", "first", "v.*"), "batch-nodes")
        self._pairs: DataFrame | None = None

    def alike(self) -> DataFrame:
        """(a, b, h, level): node a of the batch, node b alike to it or itself, of the index (h) or of the batch; how like, from 1 to 3."""
        if self._pairs is None:
            mine = materialize(blocks(self.nodes, self.index.counts, self.index.total, MEETS_LONG), "batch-blocks")
            held = self.index.read("blocks", "key", mine, "key")
            longer = mine.filter(F.col("size") > SHORT)
            if not longer.isEmpty():
                held = held.unionByName(self.index.long_blocks(longer))
            held = materialize(held, "held-blocks")  # a node that came in several tasks or batches stands there more than once
            old = materialize(split_join(mine, held, close("a", "b")).distinct(), "old-candidates")
            there = held.select("nid", "home").join(old.select(F.col("b").alias("nid")).distinct(), "nid", "left_semi").groupBy("nid").agg(F.min("home").alias("home"))
            words = self.index.words(materialize(there, "homes"))
            new = split_join(mine, mine, (F.col("a.nid") != F.col("b.nid")) & close("a", "b")).distinct()
            own = self.nodes.select("nid", "fh", "ws")
            itself = own.select(F.col("nid").alias("a"), F.col("nid").alias("b"), F.lit(False).alias("h"), F.lit(3).alias("level"))  # later rows of a node against its first
            shared, either = F.size(F.array_intersect("wa", "wb")), F.size(F.array_union("wa", "wb"))
            level = F.when((shared == either) | (F.col("fa") == F.col("fb")), 3).when(shared / either >= 0.85, 2).otherwise(1)
            found = [checked(p, own, w).select("a", "b", F.lit(h).alias("h"), level.alias("level")) for p, w, h in ((old, words, True), (new, own, False))]
            self._pairs = materialize(found[0].unionByName(found[1]).unionByName(itself), "alike")
        return self._pairs

    def _copies(self) -> DataFrame:
        """(ref) of the rows that have the forms of an earlier row."""
        mine = self.known_rows.filter("h1 is not null").select("ref", "h1", "h2")
        first = materialize(mine.groupBy("h1", "h2").agg(F.min("ref").alias("first")), "batch-forms")
        old = self.index.read("forms", "h1", first, "h1").select("h1", "h2").join(first, ["h1", "h2"], "left_semi").distinct().withColumn("old", F.lit(True))
        return mine.join(first.join(old, ["h1", "h2"], "left"), ["h1", "h2"]).filter(F.col("old").isNotNull() | (F.col("first") < F.col("ref"))).select("ref")

    def _copied(self) -> DataFrame:
        """(seq, match, from_history, p) of each row that has the forms of an earlier one; titles of any length."""
        mine = self.known_rows.filter("h1 is not null").select("ref", "day", "h1", "h2")
        old = self.index.read("days", "h1", mine.select("h1").distinct(), "h1").select("ref", "day", "h1", "h2")
        sides = old.withColumn("h", F.lit(True)).unionByName(mine.withColumn("h", F.lit(False)))
        same = materialize(sides.groupBy("h1", "h2", "h", "day").agg(F.min("ref").alias("ref")), "copies")
        days = least_of(same, ["h1", "h2", "h"], "day")
        pairs = mine.withColumnRenamed("ref", "seq").join(days, ["h1", "h2"]).join(same.withColumnRenamed("ref", "r11"), ["h1", "h2", "h", "day"], "left")
        pairs = pairs.select("seq", "h", F.lit(3).alias("level"), "r11", other_than(F.col("day"), "day").alias("r10"))
        return _patterns(pairs, ("r11", "r10"))

    def known(self) -> DataFrame:
        """(key, kind): 'copy' or 'near' of each row known already. Rows without words or forms are never known."""
        first = self.nodes.select(F.col("nid").alias("b"), F.lit(False).alias("h"), F.col("first").alias("before"))
        earlier = self.alike().join(first, ["b", "h"], "left").groupBy("a").agg(F.min("before").alias("least"), F.max("h").alias("old"))
        state = self.nodes.select("nid").join(earlier.withColumnRenamed("a", "nid"), "nid")
        near = self.titled.select("nid", "ref").join(state, "nid").filter("old or least < ref").select("ref")
        kinds = self._copies().select("ref", F.lit("copy").alias("kind")).unionByName(near.select("ref", F.lit("near").alias("kind")))
        return kinds.groupBy("ref").agg(F.min("kind").alias("kind")).select(F.col("ref.id").alias(self.key), "kind")

    def links(self) -> DataFrame:
        """(key, match, match_batch, from_history, score): the best earlier match of each row that known() gives.

        match is the id of a row of batch match_batch; from_history: of the rows that the index was made of.
        """
        nodes = self.alike()
        there = self.index.read("rows", "nid", nodes.filter("h").select("b").distinct(), "b").withColumn("h", F.lit(True))
        least = there.unionByName(self.titled.select("nid", "ref", "link", "day").withColumn("h", F.lit(False)))
        least = least.groupBy("nid", "h", "link", "day").agg(F.min("ref").alias("ref"))
        rows = self.titled.select(F.col("nid").alias("a"), F.col("ref").alias("seq"), "link", "day")
        scored = _patterns(nearest(nodes.join(rows, "a"), materialize(least, "compared")))
        scored = materialize(scored.unionByName(self._copied()).distinct(), "scored")
        counts = {tuple(r.p): r["count"] for r in scored.groupBy("p").count().collect()}  # at most 12 patterns
        table = self.index.spark.createDataFrame([(*p, s) for p, s in pattern_scores(counts).items()] or [(0, 0, 0, 0.0)], "t int, l int, y int, score double")
        found = scored.join(F.broadcast(table), (F.col("p.title") == F.col("t")) & (F.col("p.link") == F.col("l")) & (F.col("p.day") == F.col("y")))
        best = found.groupBy("seq").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("b"))
        m = F.col("b.match")
        return best.select(F.col("seq.id").alias(self.key), m["id"].alias("match"), m["batch"].alias("match_batch"), (m["batch"] == HISTORY).alias("from_history"), F.round(-F.col("b.s"), 6).alias("score"))

    def clusters(self) -> DataFrame:
        """(key, representative, representative_batch): the least row of each row's cluster; the index's mapping is brought up to date.

        Rows without forms and of fewer than six words have no row here. Calling it again changes nothing.
        """
        if not self.index.linked:
            raise ValueError("the index was made without links")
        firsts = materialize(_firsts(self.known_rows), "batch-vertices")
        pairs = self.alike().filter("a != b or h").select("a", "b", "h")
        touched = firsts.select("vertex").unionByName(pairs.filter("h").select(F.col("b").alias("vertex"))).distinct()
        touched = materialize(touched, "touched")
        held = self.index.read("members", "vertex", touched, "vertex").join(touched, "vertex", "left_semi").dropDuplicates(["vertex"])
        held = self._roots(materialize(held, "held-members"))
        of_root = F.xxhash64(F.lit("root"), "ref.batch", "ref.id")
        edges = _edges_of_rows(self.known_rows).unionByName(pairs.filter("a != b").select("a", "b")).unionByName(held.select(F.col("vertex").alias("a"), of_root.alias("b")))
        labels = materialize(components(edges.distinct()).toDF("vertex", "label"), "labels")
        refs = firsts.toDF("vertex", "ref").unionByName(held.select(of_root.alias("vertex"), "ref").distinct())
        named = materialize(refs.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex")), "labelled")
        least = named.groupBy("label").agg(F.min("ref").alias("into"))
        of_vertex = materialize(named.join(least, "label").select("vertex", "ref", "into"), "united")
        lost = held.select("ref").distinct().withColumn("vertex", of_root).join(of_vertex.select("vertex", "into"), "vertex").filter("ref != into").select("ref", "into")
        new = of_vertex.join(firsts.select("vertex"), "vertex", "left_semi").join(held.select("vertex"), "vertex", "left_anti")
        lost, new = materialize(lost, "lost-roots"), materialize(new.select("vertex", F.col("into").alias("ref")), "new-members")
        self.index._write(lost, "merges", "ref")
        self.index._write(new, "members", "vertex")
        mine = self.known_rows.select("ref", F.coalesce("nid", "h1").alias("vertex")).join(of_vertex.select("vertex", "into"), "vertex")
        return mine.select(F.col("ref.id").alias(self.key), F.col("into.id").alias("representative"), F.col("into.batch").alias("representative_batch"))

    def _roots(self, held: DataFrame) -> DataFrame:
        """held (vertex, ref) with each representative followed through the merges to its root."""
        while True:
            keys = held.select("ref").distinct()
            step = self.index.merges(keys)
            moved = materialize(held.join(step, "ref").select("vertex", F.col("into").alias("ref")), "moved")
            if moved.isEmpty():
                return held
            held = materialize(held.join(step.select("ref"), "ref", "left_anti").select("vertex", "ref").unionByName(moved), "roots")


def least_of(rows: DataFrame, by: list[str], other: str) -> DataFrame:
    """(by, one, two): of rows (by, other, ref) the least (ref, other), and the least ref whose other differs from that one's."""
    one = rows.groupBy(*by).agg(F.min(F.struct("ref", other)).alias("one"))
    two = rows.join(one, by).groupBy(*by).agg(F.min(F.when(F.col(other) != F.col(f"one.{other}"), F.col("ref"))).alias("two"))
    return one.join(two, by)


def other_than(value: Column, other: str) -> Column:
    """The least ref whose other differs from value, of the columns that least_of gives."""
    return F.when(F.col(f"one.{other}") != value, F.col("one.ref")).otherwise(F.col("two"))


def nearest(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (b, h, link, day, ...) with r11, r10, r01, r00: the least ref of node b's rows whose link and day agree (1) or differ (0).

    least: (nid, h, link, day, ref). Any row differs from one link and one day, so a few rows of a node serve all
    r00: the least of all, and the least that differ from it and from each other where a pair rules it out.
    """
    least = least.withColumnRenamed("nid", "b")
    node, v = ["b", "h"], F.struct("ref", "link", "day")
    first = lambda condition: F.min(F.when(condition, v))
    differs = lambda field, w: F.col(field) != F.col(f"{w}.{field}")
    one = least.join(least.groupBy(*node).agg(F.min(v).alias("w1")), node)
    two = one.groupBy(*node).agg(F.first("w1").alias("w1"), first(differs("link", "w1")).alias("w2"), first(differs("day", "w1")).alias("w3"), first(differs("link", "w1") & differs("day", "w1")).alias("w6"))
    four = least.join(two, node).groupBy(*node).agg(first(differs("link", "w1") & differs("day", "w2")).alias("w4"), first(differs("day", "w1") & differs("link", "w3")).alias("w5"))
    witnesses = two.join(four, node)
    links = least_of(least, [*node, "link"], "day").select(*node, "link", F.struct("one", "two").alias("by_link"))
    days = least_of(least, [*node, "day"], "link").select(*node, "day", F.struct("one", "two").alias("by_day"))
    same = least.withColumnRenamed("ref", "r11")
    out = pairs.join(witnesses, node).join(links, [*node, "link"], "left").join(days, [*node, "day"], "left").join(same, [*node, "link", "day"], "left")
    r10 = F.when(F.col("by_link.one.day") != F.col("day"), F.col("by_link.one.ref")).otherwise(F.col("by_link.two"))
    r01 = F.when(F.col("by_day.one.link") != F.col("link"), F.col("by_day.one.ref")).otherwise(F.col("by_day.two"))
    r00 = (
        F.when(differs("link", "w1") & differs("day", "w1"), F.col("w1.ref")).when(differs("day", "w1"), F.when(differs("day", "w2"), F.col("w2.ref")).otherwise(F.col("w4.ref")))
        .when(differs("link", "w1"), F.when(differs("link", "w3"), F.col("w3.ref")).otherwise(F.col("w5.ref"))).otherwise(F.col("w6.ref"))
    )
    return out.select(*pairs.columns, "r11", r10.alias("r10"), r01.alias("r01"), r00.alias("r00"))


def _patterns(pairs: DataFrame, refs: tuple[str, ...] = ("r11", "r10", "r01", "r00")) -> DataFrame:
    """(seq, match, from_history, p) of pairs (seq, h, level, refs): one row for each pattern that an earlier row has."""
    each = F.array(*[F.struct(F.col(r).alias("match"), F.struct(F.col("level").alias("title"), F.lit(int(r[1])).alias("link"), F.lit(int(r[2])).alias("day")).alias("p")) for r in refs])
    found = pairs.select("seq", F.col("h").alias("from_history"), F.explode(each).alias("x"))
    return found.select("seq", "x.match", "from_history", "x.p").filter("match is not null and (from_history or match < seq)")


def pattern_scores(counts: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Log-odds of each comparison pattern, by EM under conditional independence of the fields."""
    if not counts:
        return {}
    patterns, n = list(counts), np.array(list(counts.values()), float)
    values = [sorted({p[i] for p in patterns}) for i in range(len(patterns[0]))]
    at = np.array([[values[i].index(p[i]) for i in range(len(p))] for p in patterns])
    start = np.array([sum(x / max(1, len(v) - 1) for x, v in zip(row, values)) for row in at]) / len(values)
    g = np.clip(start, 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((g * n).sum() / n.sum(), 1e-6, 1 - 1e-6)
        m, u = [], []
        for i, v in enumerate(values):
            one = np.eye(len(v))[at[:, i]]
            m.append((1 + (one * (g * n)[:, None]).sum(0)) / (len(v) + (g * n).sum()))
            u.append((1 + (one * ((1 - g) * n)[:, None]).sum(0)) / (len(v) + ((1 - g) * n).sum()))
        odds = np.array([np.log(prior / (1 - prior)) + sum(np.log(m[i][a[i]] / u[i][a[i]]) for i in range(len(values))) for a in at])
        g = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    weight = [sum(log2(m[i][a[i]] / u[i][a[i]]) for i in range(len(values))) for a in at]
    return dict(zip(patterns, weight))
