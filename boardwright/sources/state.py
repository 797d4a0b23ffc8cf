"""State, history and model documents in JSON: read where readable, written where changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwright.operators.diff import changed_orgs
from boardwright.operators.report import archive_tail


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Rows of a JSON file; a missing file is empty, records that can't be read are left out."""
    kept = f"{schema}, _corrupt string"
    try:
        rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def write_state(before: DataFrame, after: DataFrame, path: str) -> bool:
    """Write the state (org_key, hash) if any org's set differs; says whether. path is a new folder for each state."""
    if changed_orgs(before, after).isEmpty():
        return False
    after.select("org_key", "hash").write.parquet(path)
    return True


def append_history(snapshot: DataFrame, path: str, keep: int = 365) -> DataFrame:
    """Append a snapshot's row to the history and give its last ``keep`` rows by seq."""
    snapshot.write.mode("append").parquet(path)
    return archive_tail(snapshot.sparkSession.read.parquet(path), keep)
