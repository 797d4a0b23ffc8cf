"""Session helpers: reading the tables, and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (local tests) a temporary folder is used, and deleted
    when the process ends. On a cluster a folder must be named.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="boardwright-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table, in the shared folder."""
    return f"{shared_dir(spark)}/boardwright/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of all queries; results that haven't been read yet need theirs."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/boardwright")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors. by: a column of few values, one folder each."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context, so that it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_boardwright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip" and root.is_dir():
        target = os.path.join(tempfile.mkdtemp(prefix="boardwright-"), "boardwright.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(target)
    sc._boardwright_shipped = True
