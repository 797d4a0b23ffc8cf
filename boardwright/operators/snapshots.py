"""What changed between consecutive full snapshots of nested org documents.

Keys and row contents are hashed to 64 bits in the JVM; hash buckets of compact (key, row) arrays are
sorted and compared with numpy's searchsorted; only the keys that differ are joined back to their values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FIELDS = ("title", "apply_link", "pdf_link", "date", "date_iso", "tier")
#: Rows of (key, row hash) that one bucket should hold; a bucket is compared in memory.
BUCKET_ROWS = 400_000
ADDED, REMOVED, CHANGED = 1, 2, 3


def org_versions(orgs: DataFrame) -> DataFrame:
    """One row per (snapshot, org): the row received last; of equal times the one with the greater content hash."""
    content = F.xxhash64(F.col("status"), F.to_json(F.struct("jobs")))
    return (
        orgs.filter("snapshot_id is not null and org_key is not null")
        .withColumn("_rank", F.struct(F.coalesce(F.unix_micros("received_at"), F.lit(-(2**62))), content))
        .groupBy("snapshot_id", "org_key")
        .agg(F.max_by(F.struct("status", F.coalesce("jobs", F.array()).alias("jobs")), "_rank").alias("v"))
        .select("snapshot_id", "org_key", "v.status", "v.jobs")
    )


def effective_source(versions: DataFrame) -> DataFrame:
    """For each (org, snapshot) the snapshot whose postings hold: its own if ok, the one carried over if failed.

    src is null where a failed org has nothing to carry over (no row in the snapshot before). An org has one
    row per snapshot here, so the window's partitions are as small as the number of snapshots.
    """
    w = W.partitionBy("org_key").orderBy("snapshot_id")
    chain = versions.select("org_key", "snapshot_id", "status").withColumn(
        "run", F.col("snapshot_id") - F.row_number().over(w)
    )
    in_run = W.partitionBy("org_key", "run").orderBy("snapshot_id")
    ok_at = F.when(F.col("status") == "ok", F.col("snapshot_id"))
    return chain.withColumn("src", F.last(ok_at, True).over(in_run)).drop("run")


def org_changes(states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pairs (org, snapshot) against the snapshot before: was, now (src snapshots), and the org-level change."""
    now = states.select("org_key", "snapshot_id", F.col("status").alias("s1"), F.col("src").alias("now"), F.lit(1).alias("here"))
    before = states.select("org_key", (F.col("snapshot_id") + 1).alias("snapshot_id"), F.col("status").alias("s0"), F.col("src").alias("was"), F.lit(1).alias("there"))
    both = now.join(before, ["org_key", "snapshot_id"], "full")
    both = both.join(F.broadcast(snapshots), "snapshot_id")
    change = (
        F.when(F.col("there").isNull(), "org_added")
        .when(F.col("here").isNull(), "org_removed")
        .when(~F.col("s0").eqNullSafe(F.col("s1")), "status")
    )
    return both.select("snapshot_id", "org_key", "was", "now", change.alias("change"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of one task: rows (side, key, row), compared by sorting and searchsorted."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    side = t["side"].to_numpy()
    key = t["key"].to_numpy()
    row = t["row"].to_numpy()
    pairs = np.empty(len(key), dtype=[("k", "<i8"), ("r", "<i8")])
    pairs["k"], pairs["r"] = key, row
    old, new = np.unique(pairs[side == 0]), np.unique(pairs[side == 1])  # repeats and order don't matter

    def missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
        return a if not len(b) else a[b[at] != a]

    gone, come = np.unique(missing(old, new)["k"]), np.unique(missing(new, old)["k"])
    ok, nk = np.unique(old["k"]), np.unique(new["k"])

    def has(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.zeros(len(k), bool) if not len(keys) else keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k

    differing = np.union1d(gone, come)
    kind = np.where(~has(ok, differing), ADDED, np.where(~has(nk, differing), REMOVED, CHANGED)).astype("int32")
    yield pa.RecordBatch.from_arrays([pa.array(differing, pa.int64()), pa.array(kind, pa.int32())], ["key", "kind"])


def snapshot_changes(orgs: DataFrame) -> DataFrame:
    """Rows (snapshot_id, org_key, link, change) of each snapshot against the one before.

    Null and '' are equal in the six compared fields and in the link. Empty input gives no rows; extra columns
    are ignored. The first snapshot has nothing before it and gives no rows.
    """
    spark = orgs.sparkSession
    versions = org_versions(orgs)
    states = effective_source(versions)
    snapshots = orgs.select(F.col("snapshot_id")).distinct().filter("snapshot_id is not null")
    first = snapshots.agg(F.min("snapshot_id").alias("first"))
    later = snapshots.join(F.broadcast(first), F.col("snapshot_id") > F.col("first")).select("snapshot_id")
    pairs = org_changes(states, later)
    whole = pairs.filter("change is not null").select("snapshot_id", "org_key", F.lit("").alias("link"), "change")

    moved = pairs.filter("not (was <=> now)")
    sides = moved.select(
        "org_key", "snapshot_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("was").alias("src")), F.struct(F.lit(1).alias("side"), F.col("now").alias("src")))).alias("x")
    ).select("org_key", "snapshot_id", "x.side", "x.src").filter("src is not null")
    held = versions.filter("status = 'ok' and size(jobs) > 0").select("org_key", F.col("snapshot_id").alias("src"), "jobs")
    postings = sides.join(held, ["org_key", "src"]).select("org_key", "snapshot_id", "side", F.explode("jobs").alias("j"))
    postings = postings.select(
        "org_key", "snapshot_id", "side", F.coalesce("j.link", F.lit("")).alias("link"),
        F.xxhash64("snapshot_id", "org_key", F.coalesce("j.link", F.lit(""))).alias("key"),
        F.xxhash64(*[F.coalesce(F.col(f"j.{f}"), F.lit("")) for f in FIELDS]).alias("row"),
    )
    rows = orgs.select(F.sum(F.size(F.coalesce("jobs", F.array()))).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 2 * rows // BUCKET_ROWS)
    differing = postings.select("side", "key", "row").repartition(buckets, "key").mapInArrow(_compare, "key long, kind int")
    named = F.element_at(F.array(F.lit("added"), F.lit("removed"), F.lit("changed")), F.col("kind"))
    values = postings.select("key", "snapshot_id", "org_key", "link")
    back = differing.join(values, "key").groupBy("key", "kind").agg(*[F.first(c).alias(c) for c in ("snapshot_id", "org_key", "link")])
    return whole.unionByName(back.select("snapshot_id", "org_key", "link", named.alias("change")))
