"""The interactive query: filter, search and sort nested org documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import newness


def flatten(orgs: DataFrame) -> DataFrame:
    """One row per posting of the org documents, with its org's columns."""
    named = orgs.select(*[c for c in ("snapshot_id", "org_key", "name", "category", "status") if c in orgs.columns], F.explode("jobs").alias("j"))
    return named.select(*[c for c in named.columns if c != "j"], "j.*")


def browse(jobs: DataFrame, tier: str | None = None, category: str | None = None, org: str | None = None, text: str | None = None) -> DataFrame:
    """Rows that meet all conditions given; text is looked for in title and org name, in any case."""
    out = jobs
    for column, wanted in (("tier", tier), ("category", category), ("org_key", org)):
        if wanted:
            out = out.filter(F.col(column) == wanted)
    if text:
        low = text.lower()
        out = out.filter(F.coalesce(F.lower("title").contains(low), F.lit(False)) | F.coalesce(F.lower("name").contains(low), F.lit(False)))
    return out


def sort_order(mode: str, tie: str) -> list:
    """Sort columns of 'newest', 'oldest' or 'org'; rows without a date come last in all of them."""
    day = F.nullif(F.col("date_iso"), F.lit(""))
    if mode == "newest":
        return [day.desc_nulls_last(), F.col(tie)]
    if mode == "oldest":
        return [day.asc_nulls_last(), F.col(tie)]
    return [F.lower("name").asc_nulls_last(), day.desc_nulls_last(), F.col(tie)]


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A slice of the sorted rows: a feature of the interface, Spark keeps offset + limit rows per partition."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_newness(jobs: DataFrame, as_of: str) -> DataFrame:
    n = newness(F.col("date_iso").try_cast("date"), F.to_date(F.lit(as_of)))
    return jobs.withColumn("days", n["days"]).withColumn("is_new", n["is_new"])


def orgs_with_jobs(orgs: DataFrame) -> DataFrame:
    return orgs.filter(F.size("jobs") > 0).select("org_key").distinct()
