"""Hash bitmaps of fixed size: built per task, merged by segment, broadcast to thin out a large table before a shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.llm.copies import RANGE_BITS, SEGMENT_BITS, filter_bits, ranges

#: Bits of a bitmap for each key.
BITS_PER_KEY = 16
_WIDTH = SEGMENT_BITS // 8
__all__ = ["BITS_PER_KEY", "RANGE_BITS", "build", "filter_bits", "holds", "keep"]


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def build(keys: DataFrame, column: str, bits: int) -> bytes:
    """The bitmap of column's values."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = np.unique(slots(b.column(0).to_numpy(), bits))
            np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in range(bits // SEGMENT_BITS):
            part = packed[i * _WIDTH : (i + 1) * _WIDTH]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["segment", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(p), np.uint8)
                held[i] = held[i] | part if i in held else part
        for i, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["segment", "part"])

    schema = "segment int, part binary"
    out = bytearray(bits // 8)
    for row in keys.select(column).mapInArrow(mark, schema).repartition("segment").mapInArrow(merge, schema).toLocalIterator():
        out[row.segment * _WIDTH : (row.segment + 1) * _WIDTH] = zlib.decompress(bytes(row.part))
    return bytes(out)


def holds(packed: bytes, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    f = np.frombuffer(packed, np.uint8)

    def test(keys: np.ndarray) -> np.ndarray:
        at = slots(keys, bits)
        return ((f[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    return test


def _kept(df: DataFrame, column: str, packed: bytes, bits: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = holds(shared.value, bits)
        for b in batches:
            yield b.filter(pa.array(test(b.column(column).to_numpy())))

    return df.mapInArrow(thin, df.schema)


def keep(df: DataFrame, column: str, keys: DataFrame, by: str) -> DataFrame:
    """Rows of df whose column is among ``by`` of keys (and a few others, at most one in some 16).

    Keys beyond what one bitmap of RANGE_BITS holds are cut into ranges with a bitmap each, in one plan: a row is
    tested against that of its range, so the share of others is the same at any number of keys.
    """
    n = keys.count()
    number = ranges(n, BITS_PER_KEY)
    bits, out = filter_bits(-(-n // number), BITS_PER_KEY), []
    for r in range(number):
        own = lambda d, c: d if number == 1 else d.filter(F.pmod(F.xxhash64(F.lit(number), c), F.lit(number)) == r)  # noqa: B023, E731
        out.append(_kept(own(df, column), column, build(own(keys, by), by, bits), bits))
    return reduce(DataFrame.unionByName, out)
