"""Duplicates hidden by formatting: Bloom filters find possible repeats, only those are shuffled and grouped.

Each task builds two filters over the canonical hashes of its rows, of hashes seen once and seen repeatedly.
Filters are cut into segments, merged segment by segment (a hash in two tasks has all its bits in both
filters, so the intersection goes to the repeats), and the merged filter of repeats is probed by every row.
There are no false negatives; false positives only cost a shuffled row.

A filter has a fixed most size. Rows that need more bits are cut into ranges of hashes, whose filters are built, sent
out and dropped one after the other, so the bits for each row, and with them the share of singletons that are
shuffled for nothing, are the same at any number of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import link_form, title_form
from boardwright.session import materialize

#: Bits of a filter for each row, and the bits of the filter of one range (64 MB): the bound of what is broadcast at a time.
BITS_PER_ROW, RANGE_BITS = 12, 1 << 29
SEGMENT_BITS = 1 << 18
PROBES = 2


def canonical(rows: DataFrame, key: str, title: Column, link: Column) -> DataFrame:
    """(key, h1, h2): two hashes of title form and link form; rows without title or link take no part."""
    both = F.explode(F.array(F.struct(title_form(title).alias("t"), link_form(link).alias("l")))).alias("f")  # a generator: worked out once
    forms = rows.select(F.col(key).alias("key"), both).filter("f.t != '' and f.l != ''")
    return forms.select("key", F.xxhash64("f.t", "f.l").alias("h1"), F.xxhash64("f.l", F.lit("|"), "f.t").alias("h2"))


def ranges(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    """Number of ranges of hashes whose filters have RANGE_BITS at most."""
    return max(1, -(-rows * bits_per_row // RANGE_BITS))


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    return max(SEGMENT_BITS, 1 << (max(1, rows * bits_per_row) - 1).bit_length())


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    u = h.view(np.uint64)
    return [((u >> np.uint64(31 * i)) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def _get(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (f[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _set(f: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(f, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _build(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, often = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            h, n = np.unique(b.column("h1").to_numpy(), return_counts=True)
            at = positions(h, bits)
            again = (n > 1) | np.logical_and.reduce([_get(once, p).astype(bool) for p in at])
            for p in at:
                _set(often, p[again])
                _set(once, p)
        width = SEGMENT_BITS // 8
        for i in range(bits // SEGMENT_BITS):
            part = slice(i * width, (i + 1) * width)
            if once[part].any():
                packed = [zlib.compress(x[part].tobytes(), 1) for x in (once, often)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary())], ["segment", "once", "often"])

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for i, o, r in zip(*(b.column(c).to_pylist() for c in ("segment", "once", "often"))):
            once, often = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, r))
            if i in held:
                was_once, was_often = held[i]
                held[i] = (was_once | once, was_often | often | (was_once & once))
            else:
                held[i] = (once, often)
    for i, (_, often) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(often.tobytes(), 1)], pa.binary())], ["segment", "often"])


def repeat_filter(hashes: DataFrame, bits: int) -> bytes:
    """The merged filter of repeatedly seen hashes of one range, as bytes."""
    parts = hashes.select("h1").mapInArrow(_build(bits), "segment int, once binary, often binary")
    merged = parts.repartition("segment").mapInArrow(_merge, "segment int, often binary")
    out, width = bytearray(bits // 8), SEGMENT_BITS // 8
    for row in merged.toLocalIterator():
        out[row.segment * width : (row.segment + 1) * width] = zlib.decompress(bytes(row.often))
    return bytes(out)


def _looker(shared, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            hit = np.logical_and.reduce([_get(f, p).astype(bool) for p in positions(b.column("h1").to_numpy(), bits)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, "maybe"])

    return look


def probed(rows: DataFrame, key: str, only: bool = False) -> DataFrame:
    """(key, h1, h2, maybe) of rows with both forms; maybe: whether the filter of repeats holds them. only: such rows alone.

    The hashes are written by range of h2, whose bits the filters' places don't use; ranges are worked on one by one.
    """
    number = ranges(rows.count())
    hashes = canonical(rows, key, F.col("title"), F.col("link")).withColumn("range", F.pmod("h2", F.lit(number)).cast("int"))
    hashes, done = materialize(hashes, "hashes", "range"), []
    for r in range(number):
        own = hashes.filter(F.col("range") == r).select("key", "h1", "h2")
        bits = filter_bits(own.count())
        shared = rows.sparkSession.sparkContext.broadcast(repeat_filter(own, bits))
        seen = own.mapInArrow(_looker(shared, bits), "key long, h1 long, h2 long, maybe boolean")
        done.append(materialize(seen.filter("maybe") if only else seen, "probed"))
        shared.destroy()
    return reduce(DataFrame.unionByName, done)


def _groups(maybe: DataFrame) -> DataFrame:
    """Exact groups; partial aggregates per task, so a hot group is never gathered."""
    return maybe.groupBy("h1", "h2").agg(F.min("key").alias("first_id"), F.count("*").alias("copies"))


def copies_found(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """(first_id, job_id) of each row with the forms of a row of smaller id.

    Null, empty or letterless titles and null or blank links take no part; an empty table gives no rows.
    """
    maybe = probed(jobs, key, only=True).select("key", "h1", "h2")
    groups = _groups(maybe).filter("copies > 1").select("h1", "h2", "first_id")
    return maybe.join(groups, ["h1", "h2"]).filter("key > first_id").select("first_id", F.col("key").alias(key))


def collapsed(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """(first_id, copies): one row for each distinct posting, singletons without any shuffle."""
    rows = probed(jobs, key)
    single = rows.filter("not maybe").select(F.col("key").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return single.unionByName(_groups(rows.filter("maybe")).select("first_id", "copies"))
