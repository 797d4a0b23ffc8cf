"""State of known postings per org: what is new, what is gone, whether the state must be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import identity_hash


def with_hash(postings: DataFrame) -> DataFrame:
    return postings.withColumn("hash", identity_hash(F.col("title"), F.col("link")))


def new_postings(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of current (org_key, hash, ...) that the org's state (org_key, hash) doesn't have; repeats are all given."""
    return current.join(state.select("org_key", "hash").distinct(), ["org_key", "hash"], "left_anti")


def gone_postings(current: DataFrame, state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(org_key, hash) of the state that orgs with a successful outcome no longer have."""
    ok = outcomes.filter("status = 'ok'").select("org_key")
    return state.join(ok, "org_key", "left_semi").join(current.select("org_key", "hash").distinct(), ["org_key", "hash"], "left_anti")


def next_state(current: DataFrame, state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """State after a run: replaced for orgs whose outcome is ok (also by nothing), kept for the others."""
    ok = outcomes.filter("status = 'ok'").select("org_key")
    kept = state.select("org_key", "hash").join(ok, "org_key", "left_anti")
    return kept.unionByName(current.join(ok, "org_key", "left_semi").select("org_key", "hash").distinct())


def changed_orgs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(org_key, added, removed) of orgs whose hash set differs: counts from a full join, no set is collected."""
    a, b = (x.select("org_key", "hash").distinct().withColumn(n, F.lit(1)) for x, n in ((before, "b"), (after, "a")))
    both = a.join(b, ["org_key", "hash"], "full").groupBy("org_key")
    return both.agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed")).filter("added + removed > 0")


def run_alerts(postings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of all runs that are new against the org's last successful run before: (run_id, org_key, hash, ...).

    Failed runs neither alert nor move the state; a first run alerts everything; a posting that went and came back
    alerts again. One pass over all runs: the state before a run is the org's run found by a window over outcomes.
    """
    from pyspark.sql import Window as W

    ok = outcomes.filter("status = 'ok'").select("org_key", "run_id").distinct()
    prior = ok.withColumn("before", F.lag("run_id").over(W.partitionBy("org_key").orderBy("run_id")))
    rows = postings.join(prior, ["org_key", "run_id"])
    known = postings.select("org_key", F.col("run_id").alias("before"), "hash").distinct()
    return rows.join(known, ["org_key", "before", "hash"], "left_anti").drop("before")
