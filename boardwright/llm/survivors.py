"""Best representative of each duplicate group.

``survivors`` takes each field from the row that serves it best under fixed orders (completeness, trust,
recency). ``discover_truth`` is iterative truth discovery: source reliability and weighted votes on field
values are estimated in turn until they settle, and the value of highest support survives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import letters, link_form, title_form
from boardwright.session import materialize

FIELDS = ("title", "apply_link", "pdf_link", "date")


def survivors(jobs: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per link form of two or more rows: (group_id, title_id, apply_id, pdf_id, date_id), 0 where no row can.

    A source without trust ranks below all others and a missing scraped_at is the oldest. Each field is a maximum
    of a small struct, aggregated partially in each task, so a group of any size stays distributed.
    """
    trust = trust.groupBy("source").agg(F.max("trust").alias("trust"))  # one row per source, a handful
    own = jobs.select("job_id", "link", "source", "scraped_at", *FIELDS)
    rows = own.join(F.broadcast(trust), "source", "left").select(
        "job_id", F.xxhash64(link_form(F.col("link"))).alias("h1"), F.hash(link_form(F.col("link"))).alias("h2"),
        (link_form(F.col("link")) != "").alias("linked"), "title", "apply_link", "pdf_link", "date",
        F.coalesce("trust", F.lit(-(2**31))).alias("trust"), F.coalesce(F.unix_micros("scraped_at"), F.lit(-(2**62))).alias("at"),
    ).filter("linked")

    def best(valid, *order):
        return F.when(valid, F.struct(*order, F.col("job_id").alias("id")))

    n = F.when(title_form(F.col("title")) != "", F.length(letters(F.col("title"))))
    ranked = rows.select(
        "h1", "h2", "job_id", best(n.isNotNull(), n.alias("n"), "trust", "at").alias("t"),
        best(F.col("apply_link").startswith("http"), "trust", "at").alias("a"),
        best(F.col("pdf_link").startswith("http"), "trust", "at").alias("p"),
        best(F.col("date").rlike(r"\p{Nd}"), "at").alias("d"),
    )
    groups = ranked.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("job_id").alias("group_id"), *[F.max(c).alias(c) for c in "tapd"]
    ).filter("n > 1")
    names = {"t": "title_id", "a": "apply_id", "p": "pdf_id", "d": "date_id"}
    return groups.select("group_id", *[F.coalesce(F.col(c)["id"], F.lit(0)).alias(x) for c, x in names.items()])


def discover_truth(jobs: DataFrame, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(group_id, field, value, support): for each link form of two or more rows and each field the value that holds.

    A source's vote is its weight, log((1 + e) / e) of its smoothed error rate e, the share of its claims that
    are not the value then held. Repeats of one claim by one source count once, so a source can't outvote others by
    repetition. Weights start equal; rounds end when none moves by more than tolerance. Ties go to the longer,
    then the greater value. Stand-ins such as '#' or 'N/A' are no claims.
    """
    claim = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in FIELDS]))
    rows = jobs.select("job_id", F.xxhash64(link_form(F.col("link"))).alias("g"), link_form(F.col("link")).alias("l"), F.coalesce("source", F.lit("")).alias("source"), *FIELDS).filter("l != ''")
    groups = rows.groupBy("g").agg(F.min("job_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    claims = rows.select("g", "source", claim.alias("c")).select("g", "source", "c.field", "c.value")
    claims = claims.filter(F.col("value").rlike(r"\p{L}|\p{Nd}") & ~F.lower("value").isin("n/a", "javascript:void(0);")).distinct()
    claims = materialize(claims.join(groups.select("g", "group_id"), "g").drop("g"), "claims")
    weights = {s.source: 1.0 for s in claims.select("source").distinct().collect()}  # one number per source
    spark = jobs.sparkSession

    def held(w: dict[str, float]) -> DataFrame:
        table = F.broadcast(spark.createDataFrame(list(w.items()) or [("", 1.0)], "source string, weight double"))
        votes = claims.join(table, "source").groupBy("group_id", "field", "value").agg(F.sum("weight").alias("support"))
        best = F.max(F.struct(F.round("support", 9).alias("support"), F.length("value").alias("n"), "value")).alias("b")
        return votes.groupBy("group_id", "field").agg(best).select("group_id", "field", "b.value", "b.support")

    for _ in range(rounds):
        truth = held(weights).withColumnRenamed("value", "truth")
        wrong = claims.join(truth, ["group_id", "field"]).groupBy("source").agg(F.sum((F.col("value") != F.col("truth")).cast("long")).alias("bad"), F.count("*").alias("n"))
        new = {r.source: _weight((r.bad + 1) / (r.n + 2)) for r in wrong.collect()}
        moved = max([0.0, *(abs(new.get(s, w) - w) for s, w in weights.items())])
        weights |= new
        if moved < tolerance:
            break
    return held(weights)


def _weight(error: float) -> float:
    from math import log

    return log((1 + error) / error)
