"""Coverage reports, totals, trends and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardwright.functions.text import percent, quality_label


def _tiers() -> list[Column]:
    n = lambda tier: F.count_if(F.col("relevance") == tier).alias(tier)
    return [n("relevant"), n("uncertain"), n("excluded")]


def tier_summary(postings: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row: total, relevant, uncertain, excluded, and orgs by outcome. An empty table gives zeros."""
    one = postings.agg(F.count("*").alias("total"), *_tiers())
    if outcomes is None:
        return one
    orgs = outcomes.groupBy("org_key").agg(F.max((F.col("status") == "ok").cast("int")).alias("ok"))
    return one.join(F.broadcast(orgs.agg(F.count_if(F.col("ok") == 1).alias("orgs_scraped"), F.count_if(F.col("ok") == 0).alias("orgs_failed"))))


def coverage(postings: DataFrame, orgs: DataFrame) -> DataFrame:
    """Per org: name, relevant, uncertain, total of both, percentage and quality label. The registry gives the orgs, so an
    org without postings has zeros and NOISE; a name defaults to the upper-cased key."""
    counts = postings.groupBy("org_key").agg(*_tiers()[:2])
    names = orgs.groupBy("org_key").agg(F.min("name").alias("name"))
    both = names.join(counts, "org_key", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pct = percent(zero("relevant"), zero("relevant") + zero("uncertain"))
    return both.select(
        "org_key", F.coalesce("name", F.upper("org_key")).alias("name"), zero("relevant").alias("relevant"), zero("uncertain").alias("uncertain"),
        (zero("relevant") + zero("uncertain")).alias("total"), pct.alias("relevant_pct"), quality_label(pct).alias("signal_quality"),
    )


def coverage_total(report: DataFrame) -> DataFrame:
    one = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("relevant", "uncertain", "total")])
    pct = percent(F.col("relevant"), F.col("total"))
    return one.select("*", pct.alias("relevant_pct"), quality_label(pct).alias("signal_quality"))


def tier_percentages(postings: DataFrame, by: str) -> DataFrame:
    """Shares of all three tiers."""
    n = postings.groupBy(by).agg(F.count("*").alias("total"), *_tiers())
    return n.select("*", *[percent(F.col(t), F.col("total")).alias(f"{t}_pct") for t in ("relevant", "uncertain", "excluded")])


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Per run: orgs by status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return outcomes.groupBy("run_id").agg(F.count("*").alias("orgs"), n("ok"), n("error"), n("server_down"))


def running_total(per_run: DataFrame, n: str = "new_postings") -> DataFrame:
    """Cumulative sum over runs (one row per run)."""
    return per_run.withColumn("running_total", F.sum(n).over(W.orderBy("run_id").rowsBetween(W.unboundedPreceding, 0)))


def archive_tail(history: DataFrame, keep: int = 365, seq: str = "seq") -> DataFrame:
    """The last ``keep`` snapshots by order of insertion: a top-k, taken per partition first."""
    return history.orderBy(F.desc(seq)).limit(keep)


def trend(history: DataFrame, last: int = 10) -> DataFrame:
    """Change of relevant_pct from snapshot to snapshot, over the last ones only: the first shown has none."""
    shown = archive_tail(history, last)
    return shown.withColumn("delta", F.bround(F.col("relevant_pct") - F.lag("relevant_pct").over(W.orderBy("seq")), 1))


def trend_change(history: DataFrame) -> DataFrame:
    first, final = F.min_by("relevant_pct", "seq"), F.max_by("relevant_pct", "seq")
    return history.agg(first.alias("first_pct"), final.alias("last_pct"), F.bround(final - first, 1).alias("change"))


def top_bottom(report: DataFrame, n: int = 5) -> DataFrame:
    """(side, rank, ...): the best and the worst orgs with postings; ties go by key, both sides may hold an org."""
    some = report.filter("total > 0")
    best = some.orderBy(F.desc("relevant_pct"), "org_key").limit(n).withColumn("rank", F.row_number().over(W.orderBy(F.desc("relevant_pct"), "org_key")))
    worst = some.orderBy("relevant_pct", "org_key").limit(n).withColumn("rank", F.row_number().over(W.orderBy("relevant_pct", "org_key")))
    return best.withColumn("side", F.lit("top")).unionByName(worst.withColumn("side", F.lit("bottom")))


def best_candidates(scored: DataFrame, group: str, score: str, position: str, n: int = 8) -> DataFrame:
    """The n best of each group, ties by position."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), position))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def first_seen(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key, by position: an aggregate with partial results, so a hot key is no problem."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), position).alias("_r")).select(*keys, "_r.*")


def ordered_index(rows: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """rows with their index (from 1) in a total order, without gathering them in one task.

    Range partitions are sorted, and the counts of the partitions before give each its offset.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).persist()
    counts = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # one number per partition
    at, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    table = spark.createDataFrame(offsets or [(0, 0)], "_p int, _before long")
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return placed.withColumn(name, own).join(F.broadcast(table), "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")
