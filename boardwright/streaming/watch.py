"""Watch mode: alerts on new postings from a stream of runs, with one replaceable state per org.

Each arrival is a posting or, with a null hash, the marker that a run of an org has ended with a status. State holds
the hashes of the last successful run. When a run's marker has come, its hashes are held against the state: new ones
are alerted, and the state is replaced. Failed runs neither alert nor move the state, and an empty successful run
clears it, so what disappears and returns alerts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ARRIVAL = "org_key string, run_id long, hash string, status string"
ALERT = "org_key string, run_id long, hash string"


class KnownPostings(StatefulProcessor):
    """State per org: a map of known hashes, and a map of the hashes of runs that haven't ended yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "hash string", "run_id long")
        self.open = handle.getMapState("open", "run_id long, hash string", "seen int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        org, ended = key[0], {}
        for pdf in rows:
            for run, h, status in zip(pdf["run_id"], pdf["hash"], pdf["status"]):
                if h is None or pd.isna(h):
                    ended[int(run)] = status
                else:
                    self.open.updateValue((int(run), h), (1,))
        out = []
        for run in sorted(ended):
            mine = [k[1] for k in self.open.keys() if k[0] == run]
            if ended[run] == "ok":
                out += [(org, run, h) for h in sorted(mine) if not self.known.containsKey((h,))]
                old = [k[0] for k in self.known.keys()]
                for h in set(old) - set(mine):
                    self.known.removeKey((h,))
                for h in mine:
                    self.known.updateValue((h,), (run,))
            for h in mine:
                self.open.removeKey((run, h))
        if out:
            yield pd.DataFrame(out, columns=["org_key", "run_id", "hash"])

    def close(self) -> None:
        pass


def alerts(arrivals: DataFrame) -> DataFrame:
    """Streaming (org_key, run_id, hash) of new postings; needs the RocksDB state store."""
    return arrivals.groupBy("org_key").transformWithStateInPandas(statefulProcessor=KnownPostings(), outputStructType=ALERT, outputMode="append", timeMode="none")


def arrivals_of(postings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Postings (org_key, run_id, hash) and run markers as arrivals."""
    a = postings.select("org_key", F.col("run_id").cast("long").alias("run_id"), "hash", F.lit(None).cast("string").alias("status"))
    return a.unionByName(outcomes.select("org_key", F.col("run_id").cast("long").alias("run_id"), F.lit(None).cast("string").alias("hash"), "status"))


def watch(arrivals: DataFrame, sink: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Start watching into a Parquet folder; without an interval it ends when all that is there has been read.

    ``query.stop()`` ends it gracefully at a batch boundary.
    """
    writer = alerts(arrivals).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def learn_online(success: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append (home_url, career_url) of successes to a table, from which segment counts are taken when needed."""
    writer = success.writeStream.foreachBatch(lambda df, _: df.select("home_url", "career_url").write.mode("append").parquet(path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
