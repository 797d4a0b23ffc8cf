"""Long exact spans shared between documents, by recompression.

A text is cut into tokens, and rounds of recompression name runs of equal symbols and pairs of unlike ones (each
round splits the symbols in two halves by a hash bit and joins left-right neighbours). Names are hashes of what is
named, so they are the same in all documents without an exchange of dictionaries. Each symbol carries its support:
the stretch of text that alone decides that it is there. Equal substrings thus have equal symbols wherever the
support lies inside, and a span that is shared can't hold the support of a symbol that only one text has.

Spark counts in how many texts each final symbol occurs. Stretches of ``least`` characters without the support of an
unshared symbol are the candidates, and these alone are verified, by their hash, against those of all other texts.
First those that begin at an anchor, a place that the stretch's own first characters mark: two shared ones no further
apart than their length cover all between them. The rest of a run of candidates, mostly its ends, is asked for; the
stretches asked for go into a bitmap, and every text answers with its candidates that the bitmap holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.llm import bitmaps
from boardwright.session import materialize

LEAST_CHARS = 200
#: Longest symbol that a round may make, in characters: of runs, then of pairs.
ROUNDS = ((16, 24), (0, 32), (32, 40), (0, 48))
#: Characters that are parsed at a time (a longer text is parsed alone, whole).
CHUNK_CHARS = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Some texts end to end: their code points, bounds and prefix hashes."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.cp = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = len(self.cp)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _R_INVERSE)]))
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mix(self.cp.astype(np.uint64) + _R) * powers[:n])])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each stretch, the same wherever it stands."""
        return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] ^ (end - start).astype(np.uint64))


def tokens(c: Chunk) -> dict[str, np.ndarray]:
    """Level 0: words with the white space after them. A symbol: name, start, end, support (lo, hi), text."""
    cp = c.cp
    space = (cp <= 32) | (cp == 0xA0) | (cp == 0x3000) | ((cp >= 0x2000) & (cp <= 0x200A)) | (cp == 0x2028) | (cp == 0x2029)
    first = np.zeros(len(cp) + 1, bool)
    first[1:-1] = space[:-1] & ~space[1:]
    filled = c.sizes > 0
    first[c.starts[filled]] = True
    start = np.nonzero(first[:-1])[0]
    end = np.append(start[1:], len(cp)) if len(start) else start
    text = np.searchsorted(c.ends, start, side="right")
    return {"name": c.hashes(start, end), "start": start, "end": end, "lo": start - 1, "hi": end + 1, "text": text}


def _neighbours(s: dict[str, np.ndarray], c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a left and a right neighbour is in the same text, and how far their supports reach (out of it if none)."""
    same = s["text"][1:] == s["text"][:-1]
    left, right = np.append([False], same), np.append(same, [False])
    lo = np.where(left, np.append([0], s["lo"][:-1]), c.starts[s["text"]] - 1)
    hi = np.where(right, np.append(s["hi"][1:], [0]), c.ends[s["text"]] + 1)
    return left, right, lo, hi


def _runs(s: dict[str, np.ndarray], c: Chunk, most: int) -> dict[str, np.ndarray]:
    """Name maximal runs of equal symbols of up to ``most`` characters; what isn't longer alone depends on its neighbours, in a longer run on more of it than ``most``."""
    if len(s["name"]) < 2:
        return s
    _, right, lo, hi = _neighbours(s, c)
    joined = right[:-1] & (s["name"][1:] == s["name"][:-1])
    head = np.append([True], ~joined)
    group = np.cumsum(head) - 1
    first = np.nonzero(head)[0]
    last = np.append(first[1:], len(head)) - 1
    whole = s["end"][last] - s["start"][first]
    merge = (last > first) & (whole <= most)
    could = (s["end"] - s["start"]) * 2 <= most
    k = np.nonzero(could & ((last > first) & (whole > most))[group])[0]
    n = most // (s["end"] - s["start"])[k] + 1  # so many of the run's symbols are over ``most``, which is why none is merged
    window = np.clip(k - n // 2, first[group[k]], last[group[k]] - n + 1)
    reach = np.column_stack([window, window + n]).ravel()
    far = [f.reduceat(np.append(s[x], 0), reach)[::2] for f, x in ((np.minimum, "lo"), (np.maximum, "hi"))] if len(k) else []
    s = s | {"lo": np.where(could, np.minimum(s["lo"], lo), s["lo"]), "hi": np.where(could, np.maximum(s["hi"], hi), s["hi"])}
    if len(k):
        s["lo"][k], s["hi"][k] = np.minimum(s["lo"][k], far[0]), np.maximum(s["hi"][k], far[1])
    keep = head | ~merge[group]
    at = group[keep]
    m = merge[at] & head[keep]
    out = {k: v[keep].copy() for k, v in s.items()}
    out["end"][m] = s["end"][last[at[m]]]
    out["lo"][m], out["hi"][m] = np.minimum.reduceat(s["lo"], first)[at[m]], np.maximum.reduceat(s["hi"], first)[at[m]]
    out["name"][m] = _mix(out["name"][m] * np.uint64(3) ^ (last - first + 1)[at[m]].astype(np.uint64))
    return out


def _pairs(s: dict[str, np.ndarray], c: Chunk, most: int, level: int) -> dict[str, np.ndarray]:
    """Name left-right pairs of up to ``most`` characters. A pair depends on itself alone, a lone left symbol on the next, a right one on the one before."""
    if len(s["name"]) < 2:
        return s
    _, right, lo, hi = _neighbours(s, c)
    is_left = (_mix(s["name"] ^ np.uint64(level * 2 + 1)) & np.uint64(1)).astype(bool)
    size = s["end"] - s["start"]
    pair = np.append(right[:-1] & is_left[:-1] & ~is_left[1:] & (size[:-1] + size[1:] <= most), [False])
    second = np.append([False], pair[:-1])
    lone = ~pair & ~second & (size < most)
    out_lo = np.where(lone & ~is_left, np.minimum(s["lo"], lo), s["lo"])
    out_hi = np.where(lone & is_left, np.maximum(s["hi"], hi), s["hi"])
    s = s | {"lo": out_lo, "hi": out_hi}
    i = np.nonzero(pair)[0]
    end, name, new_hi, new_lo = s["end"].copy(), s["name"].copy(), s["hi"].copy(), s["lo"].copy()
    end[i], new_hi[i] = s["end"][i + 1], np.maximum(s["hi"][i], s["hi"][i + 1])
    new_lo[i] = np.minimum(s["lo"][i], s["lo"][i + 1])
    name[i] = _mix(s["name"][i] * np.uint64(5) ^ _mix(s["name"][i + 1] + np.uint64(level)))
    s = s | {"end": end, "name": name, "hi": new_hi, "lo": new_lo}
    return {k: v[~second] for k, v in s.items()}


def parse(c: Chunk) -> dict[str, np.ndarray]:
    """The final symbols of a chunk's texts."""
    s = tokens(c)
    for level, (run, pair) in enumerate(ROUNDS):
        if run:
            s = _runs(s, c, run)
        s = _pairs(s, c, pair, level)
    return s


def with_neighbours(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The symbols, and each two neighbours of a text as one more, of the support of both."""
    i = np.nonzero(s["text"][1:] == s["text"][:-1])[0]
    two = {
        "name": _mix(s["name"][i] * np.uint64(7) ^ _mix(s["name"][i + 1] + np.uint64(99))), "lo": np.minimum(s["lo"][i], s["lo"][i + 1]),
        "hi": np.maximum(s["hi"][i], s["hi"][i + 1]), "text": s["text"][i],
    }
    return {k: np.concatenate([s[k], v]) for k, v in two.items()}


def chunks(b: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, list[str], Chunk]]:
    """The batch's texts of at least ``least`` characters, some at a time: (ids, texts, chunk)."""
    ids, texts, held = [], [], 0
    for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
        if t is not None and len(t) >= least:
            if held and held + len(t) > CHUNK_CHARS:
                yield np.array(ids), texts, Chunk(texts)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if held:
        yield np.array(ids), texts, Chunk(texts)


def _symbols(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, _, c in chunks(b, least):
                s = with_neighbours(parse(c))
                _, one = np.unique(_mix(s["name"] ^ _mix(s["text"].astype(np.uint64))), return_index=True)  # once for each text
                yield pa.RecordBatch.from_arrays([pa.array(s["name"].view(np.int64)[one]), pa.array(ids[s["text"][one]])], ["name", "id"])

    return run


def candidate_starts(c: Chunk, s: dict[str, np.ndarray], shared: np.ndarray, least: int) -> np.ndarray:
    """Starts (in the chunk) of stretches of ``least`` characters that hold no unshared symbol's support."""
    dead = np.zeros(len(c.cp) + 1, np.int32)
    lone = ~shared
    text = s["text"][lone]
    low = np.maximum(s["hi"][lone] - least, c.starts[text])
    high = np.minimum(s["lo"][lone], c.ends[text] - least)
    inside = (s["lo"][lone] >= c.starts[text]) & (s["hi"][lone] <= c.ends[text]) & (low <= high)
    np.add.at(dead, low[inside], 1)
    np.add.at(dead, high[inside] + 1, -1)
    alive = np.cumsum(dead[:-1]) == 0
    edge = np.zeros(len(c.cp) + 1, np.int32)  # a stretch ends in its text
    tail = np.maximum(c.ends - least + 1, c.starts)
    np.add.at(edge, tail, 1)
    np.add.at(edge, c.ends, -1)
    return np.nonzero(alive & (np.cumsum(edge[:-1]) == 0))[0]


REGIONS = "id long, text string, first array<int>, last array<int>"
STRETCH = "h long, id long, pos int"
#: Of the places where a word begins, one in so many is an anchor.
ANCHOR_SHARE = 1


def _lists(rows: np.ndarray, values: np.ndarray, number: int) -> pa.Array:
    """values as one list for each row; rows ascending."""
    offsets = np.searchsorted(rows, np.arange(number + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


class Region:
    """Texts of regions, some at a time, with the starts of their candidate stretches."""

    def __init__(self, ids: list[int], texts: list[str], first: list[list[int]], last: list[list[int]]):
        self.ids, self.chunk = np.array(ids), Chunk(texts)
        run = np.repeat(np.arange(len(ids)), [len(x) for x in first])
        lo, hi = (np.concatenate([np.asarray(x, np.int64) for x in v]) + self.chunk.starts[run] for v in (first, last))
        n = hi - lo + 1
        self.run = np.repeat(np.arange(len(lo)), n)
        self.at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        self.doc = np.repeat(run, n)

    def stretches(self, keep: np.ndarray, least: int) -> pa.RecordBatch:
        at, doc = self.at[keep], self.doc[keep]
        cols = [self.chunk.hashes(at, at + least).view(np.int64), self.ids[doc], (at - self.chunk.starts[doc]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "id", "pos"])

    def anchors(self, least: int) -> np.ndarray:
        """Which candidates begin with white space, a word and a hash that says so."""
        cp, at, k = self.chunk.cp, self.at, min(8, least - 1)
        begins = (cp[at] <= 32) & (cp[at + 1] > 32)
        return begins if ANCHOR_SHARE == 1 else begins & (self.chunk.hashes(at, at + k) % np.uint64(ANCHOR_SHARE) == 0)

    def open(self, known: list[list[int] | None], least: int) -> np.ndarray:
        """Which candidates aren't settled by shared anchors: anchors are, and what lies between two near enough."""
        settled = self.anchors(least)
        marks = [np.asarray(k if k is not None else [], np.int64) + s for k, s in zip(known, self.chunk.starts)]
        found = np.sort(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
        if len(found):
            after = np.searchsorted(found, self.at, side="right")
            low, high = found[np.maximum(after - 1, 0)], found[np.minimum(after, len(found) - 1)]
            between = (after > 0) & (after < len(found)) & (low <= self.at) & (high - low <= least)
            ends = self.chunk.ends
            settled |= between & (np.searchsorted(ends, low, side="right") == np.searchsorted(ends, high, side="right"))
        return ~settled


def _over_regions(b: pa.RecordBatch) -> Iterator[tuple[slice, Region]]:
    ids, texts, first, last = (b.column(c).to_pylist() for c in ("id", "text", "first", "last"))
    low = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_CHARS:
            yield slice(low, i), Region(ids[low:i], texts[low:i], first[low:i], last[low:i])
            low, held = i, 0
        held += len(t)
    if held:
        yield slice(low, len(ids)), Region(ids[low:], texts[low:], first[low:], last[low:])


def _known(stretches: DataFrame) -> DataFrame:
    """The stretches that another text has too."""
    twice = stretches.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("h")
    return stretches.join(twice, "h", "left_semi").select("id", "pos")


def shared_spans(documents: DataFrame, least: int = LEAST_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shared_chars): documents with a stretch of ``least`` characters that another document holds too.

    shared_chars counts the characters in such stretches once each. Copies of a whole text are worked on once and
    share all of it. Null, empty and shorter texts give no row; a text that only repeats itself shares nothing.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.length("text") >= least)
    marks = [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]
    same = docs.select("id", F.length("text").alias("n"), *marks).groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    same = same.persist()
    copied = docs.select("id", *marks).join(same, ["h1", "h2"]).select("id", "rep", F.col("n").cast("long").alias("shared"))
    extra = copied.filter("id != rep").select("id")
    once = docs.join(extra, "id", "left_anti")

    names = once.mapInArrow(_symbols(least), "name long, id long")
    shared = names.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("name").persist()
    bits = min(bitmaps.filter_bits(shared.count(), bitmaps.BITS_PER_KEY), bitmaps.RANGE_BITS)  # beyond that more stretches are candidates, none is lost
    packed = spark.sparkContext.broadcast(bitmaps.build(shared, "name", bits))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = bitmaps.holds(packed.value, bits)
        for b in batches:
            for ids, texts, c in chunks(b, least):
                s = with_neighbours(parse(c))
                at = candidate_starts(c, s, test(s["name"].view(np.int64)), least)
                doc = np.searchsorted(c.ends, at, side="right")
                gap = (np.diff(at) > 1) | (np.diff(doc) > 0)
                first, last = np.append([True], gap)[: len(at)], np.append(gap, [True])[-len(at) :] if len(at) else np.zeros(0, bool)
                has = np.unique(doc)
                row = np.searchsorted(has, doc)
                local = at - c.starts[doc]
                lists = [_lists(row[m], local[m], len(has)) for m in (first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array([texts[i] for i in has], pa.string()), *lists], ["id", "text", "first", "last"])

    held = materialize(once.mapInArrow(regions, REGIONS), "regions")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, r in _over_regions(b):
                yield r.stretches(r.anchors(least), least)

    settled = materialize(_known(held.mapInArrow(anchors, STRETCH)), "anchors")
    by_text = settled.groupBy("id").agg(F.collect_list("pos").alias("known"))  # at most a text's length

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column("known").to_pylist()
            for part, r in _over_regions(b):
                yield r.stretches(r.open(known[part], least), least).select(["h"])

    asked = held.join(by_text, "id", "left").mapInArrow(questions, "h long").persist()
    ask_bits = min(bitmaps.filter_bits(asked.count(), bitmaps.BITS_PER_KEY), bitmaps.RANGE_BITS)
    asked_for = spark.sparkContext.broadcast(bitmaps.build(asked, "h", ask_bits))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = bitmaps.holds(asked_for.value, ask_bits)
        for b in batches:
            for _, r in _over_regions(b):
                all_of = r.stretches(np.arange(len(r.at)), least)
                yield all_of.filter(pa.array(test(all_of.column("h").to_numpy())))

    hits = _known(held.mapInArrow(answers, STRETCH)).unionByName(settled).distinct()
    from pyspark.sql import Window as W

    step = F.lead("pos").over(W.partitionBy("id").orderBy("pos")) - F.col("pos")
    covered = hits.select("id", F.least(F.lit(least), F.coalesce(step, F.lit(least))).cast("long").alias("n")).groupBy("id").agg(F.sum("n").alias("shared"))
    every = covered.unionByName(copied.select("id", "shared")).groupBy("id").agg(F.max("shared").alias("shared"))
    return every.select(F.col("id").alias(key), F.col("shared").alias("shared_chars"))
