"""Filling fixed-capacity containers: optimal length buckets from a global histogram, batches by token budget.

Dynamic programming over the exact histogram of item lengths (at most capacity entries) chooses the bucket bounds
that minimise padding. Batches are filled from one bucket up to the budget; the room that a batch leaves is
topped up from shorter buckets, planned on the buckets' counts alone. Items find their container by their rank in
their bucket, so nothing but the histogram reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.llm.ranks import ranked
from boardwright.llm.tokens import TOKENIZER, count_tokens
from boardwright.session import materialize

BUCKETS = 256


def length_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of the buckets that minimise sum(count * (bound - length)); lengths ascending."""
    n = len(lengths)
    if n <= buckets:
        return lengths
    c = np.concatenate([[0], np.cumsum(counts)]).tolist()
    w = np.concatenate([[0], np.cumsum(counts * lengths)]).tolist()
    size = lengths.tolist()
    # A bucket over items i..j-1 costs size[j-1] * (c[j] - c[i]) - (w[j] - w[i]): of the cuts i, each a line in
    # size[j-1] of slope -c[i], the lowest is found on their lower hull, walked once for each number of buckets.
    best: list[float] = [0.0] + [float("inf")] * n
    choice = np.zeros((buckets, n + 1), np.int32)
    for k in range(buckets):
        new, hull, at = [float("inf")] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] < float("inf"):
                y = best[i] + w[i]
                while len(hull) - at > 1:
                    (p, yp), (q, yq) = hull[-2], hull[-1]
                    if (yq - yp) * (c[i] - c[q]) < (y - yq) * (c[q] - c[p]):
                        break
                    hull.pop()
                hull.append((i, y))
            x = size[j - 1]
            while at + 1 < len(hull) and hull[at + 1][1] - x * c[hull[at + 1][0]] <= hull[at][1] - x * c[hull[at][0]]:
                at += 1
            if at < len(hull):
                i, y = hull[at]
                new[j], choice[k, j] = y - x * c[i] + x * c[j] - w[j], i
        best = new
    cuts, j = [], n
    for k in range(buckets - 1, -1, -1):
        cuts.append(j)
        j = int(choice[k, j])
        if j == 0:
            break
    return lengths[np.array(sorted(cuts)) - 1]


def plan(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(bucket, from_rank, first_container, each): items of a bucket from a rank on go ``each`` to a container.

    A pattern takes what fits of the longest bucket left, then tops up from the shorter ones, and repeats as often
    as the counts allow; each pattern uses a bucket up or falls short of it in the next.
    """
    left, used, rows, container = counts.copy(), np.zeros(len(counts), np.int64), [], 0
    while left.any():
        room, take = capacity, {}
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                n = min(int(left[b]), room // int(bounds[b]))
                take[b] = n
                room -= n * int(bounds[b])
        times = min(int(left[b]) // n for b, n in take.items())
        for b, n in take.items():
            rows.append((b, int(used[b]), container, n))
            used[b] += n * times
            left[b] -= n * times
        container += times
    return rows


def pack(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(container, key, piece, first_token, tokens, bin): where each text, or each piece of a text that alone exceeds
    the container, lies; bins are numbered from 0 in each container size.

    A text of no tokens takes no room and lies in bin 0. Containers of a null or non-positive capacity are left out;
    of equal names the smallest capacity holds. A text is cut into full pieces and one rest.
    """
    spark = documents.sparkSession
    sized = materialize(count_tokens(documents, tokenizer, key, text).withColumnRenamed(key, "id"), "sizes")
    sizes = {r.container: r.capacity for r in capacities.filter("capacity_tokens > 0").groupBy("container").agg(F.min("capacity_tokens").alias("capacity")).collect()}
    if not sizes:
        return spark.createDataFrame([], f"container string, {key} long, piece int, first_token int, tokens int, bin long")
    each = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).alias("capacity")) for c, n in sizes.items()])
    items = sized.select("id", "n_tokens", F.explode(each).alias("c")).select("id", "n_tokens", "c.container", "c.capacity")
    n = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("int")
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    start = (F.col("piece") * F.col("capacity")).cast("int")
    items = items.select("container", "id", "piece", start.alias("first_token"), F.least("capacity", F.col("n_tokens") - start).alias("tokens"))
    # capacity is at most some thousands of tokens: so are a container's rows here
    histogram = items.filter("tokens > 0").groupBy("container", "tokens").count().collect()
    bounds, rows = {}, []
    for c, capacity in sizes.items():
        own = sorted((r.tokens, r["count"]) for r in histogram if r.container == c)
        lengths, counts = np.array([x for x, _ in own], np.int64), np.array([x for _, x in own], np.int64)
        bounds[c] = length_bounds(lengths, counts, buckets) if len(own) else np.zeros(0, np.int64)
        held = np.bincount(np.searchsorted(bounds[c], lengths), counts, len(bounds[c])).astype(np.int64)
        for b, first, container, each in plan(bounds[c], held, capacity):
            rows.append((c, b, first, container, each))
    total = sum(r["count"] for r in histogram)
    shared = spark.sparkContext.broadcast((bounds, rows))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, tokens = np.array(b.column("container").to_pylist(), object), b.column("tokens").to_numpy()
            out = np.full(len(tokens), -1, np.int32)
            for c, x in shared.value[0].items():
                own = (names == c) & (tokens > 0)
                out[own] = np.searchsorted(x, tokens[own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "bucket"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for c, b, first, container, each in shared.value[1]:
            table.setdefault((c, b), []).append((first, container, each))
        table = {k: np.array(sorted(v)) for k, v in table.items()}
        for b in batches:
            names, bucket, rank = b.column("container").to_pylist(), b.column("bucket").to_pylist(), b.column("rank").to_numpy()
            group: dict = {}
            for i, k in enumerate(zip(names, bucket)):
                group.setdefault(k, []).append(i)
            out = np.zeros(len(rank), np.int64)
            for k, i in group.items():
                if k in table:
                    t = table[k]
                    at = np.searchsorted(t[:, 0], rank[i], side="right") - 1
                    out[i] = t[at, 1] + (rank[i] - t[at, 0]) // t[at, 2]
            cols = [b.column(x) for x in ("container", "id", "piece", "first_token", "tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out)], ["container", "id", "piece", "first_token", "tokens", "bin"])

    schema = "container string, id long, piece int, first_token int, tokens int"
    in_bucket = items.mapInArrow(bucketed, f"{schema}, bucket int")
    with_rank = ranked(in_bucket, ["container", "bucket"], F.struct("id", "piece"), total)
    out = with_rank.select("container", "id", "piece", "first_token", "tokens", "bucket", "rank").mapInArrow(placed, f"{schema}, bin long")
    return out.withColumnRenamed("id", key)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, bin, pieces, used_tokens, capacity_tokens, fill) of each container filled."""
    size = capacities.filter("capacity_tokens > 0").groupBy("container").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    used = packed.groupBy("container", "bin").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("used_tokens"))
    return used.join(F.broadcast(size), "container").withColumn("fill", F.col("used_tokens") / F.col("capacity_tokens"))
