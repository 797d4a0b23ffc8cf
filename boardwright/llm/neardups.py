"""Near-duplicate titles: block join, distance check on the folds, exact check on the words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.llm import bitmaps
from boardwright.llm.blocking import MEETS_LONG, SHORT, alike, blocks, close, slot_counts, split_join, titled
from boardwright.llm.copies import canonical
from boardwright.operators.components import components
from boardwright.session import materialize


def nodes_of(titles: DataFrame) -> DataFrame:
    """(nid, fh, ws) of the distinct nodes: repeats are combined in each task, so a title of a third of all rows is one row."""
    return titles.groupBy("nid").agg(F.first(F.struct("fh", "ws")).alias("v")).select("nid", "v.*")


def alike_nodes(titles: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (word set and form), a < b, whose titles are alike and of different forms.

    titles: (nid, fh, ws), as ``titled`` gives; equal nodes are one node, cut into blocks once.
    """
    nodes = materialize(nodes_of(titles), "nodes")
    counts, many = slot_counts(nodes)
    total = max(int(counts.sum()) // 10, 2)
    cut = blocks(nodes, counts, total)
    pairs = split_join(cut, cut, (F.col("a.nid") < F.col("b.nid")) & close("a", "b"))
    if many:  # titles that only long blocks serve
        pairs = pairs.unionByName(_long_pairs(nodes, counts, total))
    return checked(pairs.distinct(), nodes, nodes).filter("fa != fb").select("a", "b")


def checked(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, fa, fb, wa, wb) of the pairs whose words pass the exact test; forms and words come from (nid, fh, ws)."""
    side = lambda d, s: d.select(F.col("nid").alias(s), F.col("fh").alias(f"f{s}"), F.col("ws").alias(f"w{s}"))
    return pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").filter(alike(F.col("wa"), F.col("wb")))


def _long_pairs(nodes: DataFrame, counts, total: int) -> DataFrame:
    """Candidates with at least one title longer than SHORT; of the shorter ones only blocks that a long title has."""
    cut = materialize(blocks(nodes.filter(F.size("ws") > SHORT), counts, total, SHORT + 1, short=False), "long-blocks")
    less = blocks(nodes.filter(F.size("ws").between(MEETS_LONG, SHORT)), counts, total, MEETS_LONG, short=False)
    less = materialize(bitmaps.keep(less, "key", cut, "key"), "met-blocks")
    one_way = (F.col("a.nid") < F.col("b.nid")) | (F.col("b.size") <= SHORT)
    near = split_join(cut, cut.unionByName(less), (F.col("a.nid") != F.col("b.nid")) & one_way & close("a", "b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_pairs(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """(job_a, job_b), job_a < job_b: rows whose titles are alike but have different forms.

    Titles of fewer than six words, null and empty ones are alike to none. The pairs of rows are the members of alike
    nodes, multiplied out; ``near_classes`` gives one row for each member instead.
    """
    titles = titled(jobs, key)
    members = materialize(titles.select("nid", "key"), "members")
    side = lambda s: members.select(F.col("nid").alias(s), F.col("key").alias(f"job_{s}"))
    rows = alike_nodes(titles).join(side("a"), "a").join(side("b"), "b")
    return rows.select(F.least("job_a", "job_b").alias("job_a"), F.greatest("job_a", "job_b").alias("job_b"))


def near_classes(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, class_id, links): each row of six words or more with the smallest id of its class and its node's links.

    A class is a connected component of alike titles and of equal ones; links counts alike nodes of another form.
    """
    titles = titled(jobs, key)
    edges = materialize(alike_nodes(titles), "near-edges")
    titles = materialize(titles.select("nid", "key"), "members")
    members = titles.groupBy("nid").agg(F.min("key").alias("rep"))
    named = edges.join(members.toDF("a", "ra"), "a").join(members.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    labels = components(named)
    degree = edges.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("links"))
    nodes = members.join(degree, "nid", "left").join(labels.toDF("rep", "label"), "rep", "left")
    nodes = nodes.select("nid", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return titles.select(F.col("key").alias(key), "nid").join(nodes, "nid").select(key, "class_id", "links")


def all_classes(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, class_id, links): near_classes, and the rows of titles that it leaves out, with 0 links.

    Of those, exact copies (title form and link form) have the least id of them as class_id, the rest their own.
    """
    near = materialize(near_classes(jobs, key), "near-classes")
    rest = jobs.select(key, "title", "link").join(near.select(key), key, "left_anti")  # titles aren't cut into words once more
    forms = canonical(rest, key, F.col("title"), F.col("link"))
    copied = forms.groupBy("h1", "h2").agg(F.min("key").alias("class_id"))
    named = forms.join(copied, ["h1", "h2"]).select(F.col("key").alias(key), "class_id")
    short = rest.select(key).join(named, key, "left").select(key, F.coalesce("class_id", key).alias("class_id"), F.lit(0).cast("long").alias("links"))
    return near.unionByName(short)
