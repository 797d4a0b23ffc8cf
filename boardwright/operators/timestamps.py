"""Mixed timestamp formats and zones: a dictionary of distinct raw values, parsed once and joined back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.instants import to_epoch_us
from boardwright.session import scratch_path


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values, zones = b.column("value").to_pylist(), b.column("tz").to_pylist()
        got = pa.array([to_epoch_us(v, z) for v, z in zip(values, zones)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("value"), b.column("tz"), got], ["value", "tz", "epoch_us"])


def extend_dictionary(values: DataFrame, path: str) -> DataFrame:
    """Add to the dictionary at path those of values (value, tz) that it lacks; returns the whole dictionary.

    Values already in it aren't parsed again. Unreadable values are kept with a null moment.
    """
    spark = values.sparkSession
    schema = "value string, tz string, epoch_us long"
    new = values.select("value", "tz").distinct()
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(spark.read.schema(schema).parquet(path), ["value", "tz"], "left_anti")
    new.mapInArrow(_parse, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def written_dates(rows: DataFrame, zones: DataFrame, fields: tuple[str, ...], key: str, zone: Column) -> DataFrame:
    """Long form (key, field, value, tz) of the date fields that hold a digit; the rest names no day."""
    zones = zones.groupBy("org_key").agg(F.min("tz").alias("tz"))  # one row per org, some hundreds
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in fields]))
    long = rows.select(key, "org_key", pairs.alias("p")).select(key, "org_key", "p.field", "p.value")
    long = long.filter(F.col("value").rlike(r"\p{Nd}"))
    return long.join(F.broadcast(zones), "org_key", "left").select(key, "field", "value", F.coalesce(zone, F.lit("UTC")).alias("tz"))


def normalise_dates(rows: DataFrame, zones: DataFrame, fields: tuple[str, ...] = ("date", "date_iso"), key: str = "job_id", dictionary: str | None = None) -> DataFrame:
    """Rows (key, field, epoch_us), one for each date value that names a real calendar day.

    Null, empty and unreadable values give no row. An org without a zone is read as UTC. ``dictionary`` is a path
    that outlives the call, so that a later call parses new values only; without it a scratch path is used.
    """
    spark = rows.sparkSession
    long = written_dates(rows, zones, fields, key, F.col("tz"))
    known = extend_dictionary(long, dictionary or scratch_path(spark, "dates")).filter("epoch_us is not null")
    return long.join(known, ["value", "tz"]).select(key, "field", "epoch_us")
