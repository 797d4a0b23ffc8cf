"""Pigeonhole blocks of word-set fingerprints, for Jaccard similarity of at least 7/10, without a miss.

A title's fingerprint is the bit vector of its words, rarest first. Two titles of a and b words are alike iff the
Hamming distance of their fingerprints is at most 3(a + b) / 17. So a title has at most floor(0.3 a) words that an
alike title lacks, and of its rarest words all but that many are shared: cut the fingerprint into blocks of its
rarest words, leaving out up to that many, and alike titles share the block of their rarest shared words.

A block grows word by word until its words together are rare enough (the sum of log2(N / count) reaches log2 N,
with a rare word among them), so no block is crowded by stock phrases. Where the words never get that rare, a
block ends at the least overlap that a pair of the greater size M needs, and holds M in its key. The rule depends on
the words alone, so both titles of a pair cut the same block. The order is by exact counts in ORDER_SLOTS hash slots,
a table of fixed size at any scale; any common order is correct, a good one is selective.

Growing blocks would be too many for long titles. Pairs whose greater size exceeds SHORT meet in blocks of fixed
length instead: pairs of the rarest words up to MIDDLE, single rarest words beyond. Shorter titles cut such blocks
only to meet a longer one. All three kinds of block lose no pair; a hot block, of a word that many long titles hold, is
cut up in the join (see split_join).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.functions.text import title_form, title_words
from boardwright.session import materialize

LEAST_WORDS = 6
#: Greatest sizes of pairs that growing blocks and two-word blocks are for, and the least size that can meet a longer title.
SHORT, MIDDLE = 16, 40
MEETS_LONG = -(-(SHORT + 1) * 7 // 10)
_MANY = -(2**63)
ORDER_SLOTS = 1 << 16
#: A word is rare if it stands in fewer than one title in 2 ** RARE_BITS.
RARE_BITS = 10
BLOCK_SCHEMA = "key long, nid long, fp int, size int, skips int"
#: Bits of the folds of fingerprints; fewer than an int's, so that none is negative.
FOLD_BITS = 31


def titled(rows: DataFrame, key: str, title: str = "title") -> DataFrame:
    """(key, nid, fh, ws) of titles of six words and more; ws: word hashes in order, fh: hash of the form, nid: of word set and form."""
    words = rows.select(F.col(key).alias("key"), F.xxhash64(title_form(F.col(title))).alias("fh"), word_hashes(F.col(title)).alias("ws"))
    return words.filter(F.size("ws") >= LEAST_WORDS).select("key", node_id().alias("nid"), "fh", "ws")


def word_hashes(title: Column) -> Column:
    """Hashes of the distinct words, sorted. As a generator of one row, so that a filter on it isn't pushed below and worked out twice."""
    return F.explode(F.array(F.sort_array(F.transform(title_words(title), lambda w: F.xxhash64(w)))))


def node_id() -> Column:
    return F.xxhash64("ws", "fh")


def slot_counts(titles: DataFrame) -> tuple[np.ndarray, int]:
    """Exact number of titles' words in each slot, over all titles, and the number of titles longer than SHORT.

    ORDER_SLOTS numbers and one more come to the driver.
    """
    marked = F.when(F.size("ws") > SHORT, F.concat("ws", F.array(F.lit(_MANY)))).otherwise(F.col("ws"))
    slot = F.when(F.col("h") == _MANY, ORDER_SLOTS).otherwise(F.col("h").bitwiseAND(ORDER_SLOTS - 1).cast("int"))
    out = np.zeros(ORDER_SLOTS + 1, np.int64)
    for r in titles.select(F.explode(marked).alias("h")).groupBy(slot.alias("slot")).count().collect():
        out[r["slot"]] = r["count"]
    return out[:-1], int(out[-1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


Blocks = tuple[np.ndarray, np.ndarray, np.ndarray]


def _part(flat: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, hashes and sizes of the word sets to keep."""
    return np.nonzero(keep)[0], flat[np.repeat(keep, sizes)], sizes[keep]


def _ordered(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of each word, and the words and their counts, rarest first in each row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    count = np.maximum(counts[flat & (ORDER_SLOTS - 1)], 1)
    order = np.lexsort((flat, count, row))
    return row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), flat[order].view(np.uint64), count[order]


def long_blocks(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> Blocks:
    """(row, key, skips) of the blocks in which pairs meet whose greater size exceeds SHORT."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    rows, flat, sizes = _part(flat, sizes, sizes >= MEETS_LONG)
    if len(rows):
        row, at, words, _ = _ordered(flat, sizes, counts)
        starts = np.cumsum(sizes) - sizes
        for a in np.unique(sizes[sizes <= MIDDLE]):
            i, j = np.triu_indices(a * 3 // 10 + 2, 1)
            own = np.nonzero(sizes == a)[0]
            first, second = words[starts[own][:, None] + i], words[starts[own][:, None] + j]
            key = _mix(_mix(first ^ np.uint64(2)) ^ second)
            out.append((np.repeat(rows[own], len(i)), key.ravel(), np.tile(j - 1, len(own))))
        one = (sizes[row] * 10 // 7 > MIDDLE) & (at <= sizes[row] * 3 // 10)
        out.append((rows[row[one]], _mix(words[one] ^ np.uint64(1)), at[one]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def short_blocks(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, total: int) -> Blocks:
    """(row, key, skips) of the blocks in which pairs meet whose greater size is at most SHORT."""
    rows, flat, sizes = _part(flat, sizes, sizes <= SHORT)
    if not len(rows):
        return rows, np.zeros(0, np.uint64), rows
    row, key, skips = cut_blocks(flat, sizes, counts, total)
    return rows[row], key, skips


def all_blocks(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, total: int, least_long: int) -> Blocks:
    """Short blocks, and long ones of titles of at least least_long words."""
    a = short_blocks(flat, sizes, counts, total)
    rows, flat, sizes = _part(flat, sizes, sizes >= least_long)
    row, key, skips = long_blocks(flat, sizes, counts)
    return np.concatenate([a[0], rows[row]]), np.concatenate([a[1], key]), np.concatenate([a[2], skips])


def cut_blocks(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, total: int) -> Blocks:
    """(row, key, skips) of the growing blocks of the word sets given by flat hashes and sizes."""
    n = len(sizes)
    row_of, at, ordered, count = _ordered(flat, sizes, counts)
    width = int(sizes.max())
    words, bits = np.zeros((n, width), np.uint64), np.zeros((n, width), np.float32)
    words[row_of, at] = ordered
    bits[row_of, at] = np.log2(np.maximum(total / count, 1.0))
    enough = np.float32(np.log2(max(total, 2)))
    spare = (sizes * 3) // 10

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # a state: a block under way; row, next word, words taken, words left out, bits so far, rare word among them, key, M and its limits
    zero = np.zeros(n, np.int64)
    s = {"row": np.arange(n), "pos": zero, "m": zero, "skips": zero, "bits": np.zeros(n, np.float32), "rare": np.zeros(n, bool), "key": np.full(n, 0x9E3779B97F4A7C15, np.uint64), "spare": spare, "cap": np.full(n, 99)}

    def grow(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        new = []
        for extra in range(int(s["spare"].max(initial=0)) + 1):
            take = s["pos"] + extra
            ok = (s["skips"] + extra <= s["spare"]) & (take < sizes[s["row"]])
            if ok.any():
                x, take = {k: v[ok] for k, v in s.items()}, take[ok]
                gained = bits[x["row"], take]
                x |= {"pos": take + 1, "m": x["m"] + 1, "skips": x["skips"] + extra, "bits": x["bits"] + gained, "rare": x["rare"] | (gained >= RARE_BITS), "key": _mix(x["key"] ^ words[x["row"], take])}
                new.append(x)
        return {k: np.concatenate([x[k] for x in new]) for k in s} if new else {k: v[:0] for k, v in s.items()}

    def emit(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        done = (s["m"] >= 2) & (((s["bits"] >= enough) & s["rare"]) | (s["bits"] >= 2 * enough)) | (s["m"] >= s["cap"])
        out.append((s["row"][done], s["key"][done], s["skips"][done]))
        return {k: v[~done] for k, v in s.items()}

    for _ in range(5):
        s = emit(grow(s))
    by_size = []
    if len(s["row"]):
        a = sizes[s["row"]]
        for more in range(int((a.max() * 10) // 7 - a.max()) + 1):
            greater = a + more
            limit = a * 3 // 10 if more == 0 else (10 * a - 7 * greater) // 17
            ok = (greater * 7 <= a * 10) & (greater <= SHORT) & (s["skips"] <= limit)
            if ok.any():
                x = {k: v[ok] for k, v in s.items()}
                x |= {"spare": limit[ok], "cap": -(-greater[ok] * 7 // 10), "key": _mix(x["key"] ^ greater[ok].astype(np.uint64))}
                by_size.append(x)
    if by_size:
        s = emit({k: np.concatenate([x[k] for x in by_size]) for k in s})
        while len(s["row"]):
            s = emit(grow(s))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def fingerprints(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Folds of the fingerprints to FOLD_BITS bits: a pair's folds differ in no more bits than its fingerprints."""
    bit = np.left_shift(np.int32(1), ((flat.view(np.uint64) >> np.uint64(40)) % np.uint64(FOLD_BITS)).astype(np.int32))
    return np.bitwise_xor.reduceat(bit, np.cumsum(sizes) - sizes)


def block_maker(cut: Callable[[np.ndarray, np.ndarray], Blocks], extra: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ws = b.column("ws")
            flat, sizes = ws.flatten().to_numpy(), ws.value_lengths().to_numpy().astype(np.int64)
            row, key, skips = cut(flat, sizes)
            fp = fingerprints(flat, sizes)
            own = [b.column(c).to_numpy()[row] for c in ("nid", *extra)]
            cols = [key.view(np.int64), own[0], fp[row], sizes[row].astype(np.int32), skips.astype(np.int32), *own[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "nid", "fp", "size", "skips", *extra])

    return make


def blocks(nodes: DataFrame, counts: np.ndarray, total: int, least_long: int | None = None, short: bool = True, home: bool = False) -> DataFrame:
    """(key, nid, fp, size, skips) of nodes (nid, ws): short blocks, long ones from least_long words on, or both; with the node's home if wanted."""

    def cut(flat: np.ndarray, sizes: np.ndarray) -> Blocks:
        if least_long is None:
            return short_blocks(flat, sizes, counts, total)
        return all_blocks(flat, sizes, counts, total, least_long) if short else long_blocks(flat, sizes, counts)

    extra = ("home",) if home else ()
    return nodes.select("nid", "ws", *extra).mapInArrow(block_maker(cut, extra), BLOCK_SCHEMA + (", home long" if home else ""))


#: Rows of a block that meet in one task; a block of more is cut into groups of about so many, each two of which meet by themselves.
GROUP_ROWS = 2000


def split_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """(a, b) of rows a of left and b of right, of one block each, for which the condition on columns a.* and b.* holds.

    Blocks with more than GROUP_ROWS rows on a side are cut: each row is in one group of its side and meets each group
    of the other, so no task holds more than two groups of a block, whatever its size.
    """
    sized = lambda d, n: d.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_ROWS).select("key", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias(n))
    hot = sized(left, "na").join(sized(right, "nb"), "key", "full").select("key", F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb"))
    hot = materialize(hot, "hot-blocks")
    pairs = lambda a, b, on: a.alias("a").join(b.alias("b"), on & condition).select(F.col("a.nid").alias("a"), F.col("b.nid").alias("b"))
    same = F.col("a.key") == F.col("b.key")
    if hot.isEmpty():
        return pairs(left, right, same)
    cold = pairs(left.join(hot, "key", "left_anti"), right.join(hot, "key", "left_anti"), same)
    group = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(hot, "key").select(*left.columns, group("na").alias("ga"), every("nb").alias("gb"))
    b = right.join(hot, "key").select(*right.columns, every("na").alias("ga"), group("nb").alias("gb"))
    return cold.unionByName(pairs(a, b, same & (F.col("a.ga") == F.col("b.ga")) & (F.col("a.gb") == F.col("b.gb"))))


def close(a: str, b: str) -> Column:
    """Whether rows a and b of blocks can be alike: by size, by words left out and by distance of the folds."""
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    return (
        (17 * (F.col(f"{a}.size") - F.col(f"{a}.skips")) >= 7 * both)
        & (17 * (F.col(f"{b}.size") - F.col(f"{b}.skips")) >= 7 * both)
        & (17 * F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= 3 * both)
    )


def alike(a: Column, b: Column) -> Column:
    """The exact test on the words (their 64-bit hashes) of two titles: 17 times the shared ones reach 7 times those of both."""
    return (F.size(a) >= LEAST_WORDS) & (F.size(b) >= LEAST_WORDS) & (17 * F.size(F.array_intersect(a, b)) >= 7 * (F.size(a) + F.size(b)))
