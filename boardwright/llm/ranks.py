"""Ranks within groups of any size: a group is salted into sub-groups, and their counts give the offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one sub-group of a group of all rows should hold.
SUB_ROWS = 100_000


def ranked(df: DataFrame, groups: list[str], order: Column, rows: int, name: str = "rank") -> DataFrame:
    """df with the rank (from 0) of each row in its group; order must tell rows apart. rows: about how many df has."""
    subs = max(1, rows // SUB_ROWS)
    salted = df.withColumn("_sub", F.pmod(F.xxhash64(order), F.lit(subs)))
    counts = salted.groupBy(*groups, "_sub").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*groups, "_sub", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*groups, "_sub").orderBy(order)) - 1
    return salted.withColumn("_own", own).join(offsets, [*groups, "_sub"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_sub", "_own", "_before")
