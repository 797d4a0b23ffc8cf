import random

import numpy as np
import pytest

from boardwright.llm import mixing, packing, ranks, spans, tokens

DOCS = "doc_id long, text string, source string, rank long"


def brute_shared(docs, least):
    first, shared = {}, set()
    for i, t in docs:
        for p in range(len(t or "") - least + 1):
            w = t[p : p + least]
            if first.setdefault(w, i) != i:
                shared.add(w)
    out = {}
    for i, t in docs:
        last = n = 0
        for p in range(len(t or "") - least + 1):
            if t[p : p + least] in shared:
                n += p + least - max(last, p)
                last = p + least
        if n:
            out[i] = n
    return out


def made(seed, n, least):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["", "पद", "é"]) + "".join(rng.choices("abcdef", k=rng.randrange(1, 9))) for _ in range(40)]
    text = lambda k: rng.choice([" ", "  ", "\n"]).join(rng.choices(vocabulary, k=k))
    pool = [text(rng.randrange(3, 60)) for _ in range(6)] + ["-" * 3 * least, "ab" * least, " " * 2 * least, "x" * (least - 1)]
    docs = []
    for i in range(n):
        parts = [rng.choice([text(rng.randrange(0, 25)), rng.choice(pool), rng.choice(pool)[rng.randrange(9) :]]) for _ in range(rng.randrange(0, 5))]
        docs.append((i, rng.choice(["", " ", "."]).join(parts)))
    docs += [(n, docs[0][1]), (n + 1, docs[0][1]), (n + 2, None), (n + 3, "")]
    return docs


@pytest.mark.parametrize("seed,least", [(1, 200), (2, 60), (3, 40), (4, 12)])
def test_shared_spans(spark, seed, least):
    docs = made(seed, 60, least)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], DOCS).repartition(3)
    got = {r.doc_id: r.shared_chars for r in spans.shared_spans(df, least).collect()}
    assert got == brute_shared(docs, least)


def test_shared_spans_edges(spark):
    assert spans.shared_spans(spark.createDataFrame([], DOCS)).collect() == []
    once = [(1, "abc " * 100, "s", 1), (2, "short", "s", 1)]  # repeats itself only
    assert spans.shared_spans(spark.createDataFrame(once, DOCS)).collect() == []
    long = "".join(random.Random(1).choices("abcdefgh ", k=60_000))
    two = [(1, long, "s", 1), (2, "q" * 50 + long[1000:31_000], "s", 1)]
    assert {r.doc_id: r.shared_chars for r in spans.shared_spans(spark.createDataFrame(two, DOCS)).collect()} == {1: 30_000, 2: 30_000}


def test_support_decides_symbols():
    """A symbol whose support lies in a span stands at the same place of the span wherever it is."""
    rng = random.Random(2)
    for _ in range(30):
        core = " ".join("".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(60))
        sets = []
        for _ in range(2):
            left, right = ("".join(rng.choices("abc  ", k=rng.randrange(0, 40))) for _ in range(2))
            c = spans.Chunk(["zz", left + core + right])
            s, at = spans.parse(c), 2 + len(left)
            inside = (s["lo"] >= at) & (s["hi"] <= at + len(core))
            sets.append({tuple(x) for x in zip(s["name"][inside], s["start"][inside] - at, s["end"][inside] - at)})
        assert sets[0] == sets[1] and sets[0]


def test_runs_of_different_length_before_one_passage():
    """No stretch of 200 characters that both texts have is excluded, whatever the lengths of the runs beside it."""
    rng, missed, least = random.Random(4), [], 200
    cases = [("* ", 20, 12, 176, "", "")]
    cases += [(rng.choice(["* ", "- ", "ab ", "a b ", "* * - ", "word "]), rng.randrange(2, 40), rng.randrange(2, 40), rng.randrange(120, 260), *rng.choices(["", "x ", "zz yy "], k=2)) for _ in range(400)]
    for unit, m, n, size, left, right in cases:
        passage = "".join(rng.choice("abcdefgh ") for _ in range(size))
        for turned in (False, True):  # the run before the passage, or after it
            texts = [x + unit * k + passage if not turned else passage + " " + unit * k + x for x, k in ((left, m), (right, n))]
            c = [spans.Chunk([x]) for x in texts]
            s = [spans.with_neighbours(spans.parse(x)) for x in c]
            both = np.intersect1d(s[0]["name"], s[1]["name"])
            for i in (0, 1):
                kept = set(spans.candidate_starts(c[i], s[i], np.isin(s[i]["name"], both), least).tolist())
                other = texts[1 - i]
                missed += [(unit, m, n, p) for p in range(len(texts[i]) - least + 1) if texts[i][p : p + least] in other and p not in kept]
    assert missed == []


def test_length_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 40, 9))
        counts, k = rng.integers(1, 9, len(lengths)), int(rng.integers(1, 5))
        cost = lambda b: sum(c * (b[np.searchsorted(b, x)] - x) for x, c in zip(lengths, counts))  # noqa: B023, E731
        from itertools import combinations

        best = min(cost(np.array(sorted({*x, int(lengths[-1])}))) for x in combinations(lengths.tolist(), min(k, len(lengths)) - 1)) if k > 1 else cost(lengths[-1:])
        got = packing.length_bounds(lengths, counts, k)
        assert got[-1] == lengths[-1] and len(got) <= max(k, 1) and cost(got) == best


def test_pack(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.choice([1, 3, 5, 9, 20, 40, 150]), "s", 1) for i in range(300)] + [(300, None, None, 1), (301, "", "s", 1), (302, "long " * 3000, "s", 1)]
    df = spark.createDataFrame(docs, DOCS)
    size = {"a": 32, "b": 128}
    capacities = spark.createDataFrame([("a", 32), ("b", 128), ("zero", 0), ("none", None)], "container string, capacity_tokens int")
    got = packing.pack(df, capacities).collect()
    count = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    for c, cap in size.items():
        rows = [r for r in got if r.container == c]
        used, pieces = {}, {}
        for r in rows:
            used[r.bin] = used.get(r.bin, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        assert max(used.values()) <= cap and set(pieces) == set(count)
        for i, p in pieces.items():
            p.sort()
            assert sum(n for _, n in p) == count[i] and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and (len(p) == 1) == (count[i] <= cap)
        assert sum(used.values()) / (cap * len(used)) > 0.9 and sorted(used) == list(range(len(used)))
    assert packing.pack(df.limit(0), capacities).collect() == [] and packing.pack(df, capacities.limit(0)).collect() == []
    f = packing.fill(packing.pack(df, capacities), capacities)
    assert f.filter("used_tokens > capacity_tokens").count() == 0 and f.count() > 0


def test_ranks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ranks, "SUB_ROWS", 50)
    df = spark.range(2000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    got = {}
    for r in ranks.ranked(df, ["g"], F.col("id"), 2000).collect():
        got.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randrange(1, 60), rng.choice("aaaaabbc"), 1) for i in range(1200)] + [(1200, "", "a", 1), (1201, None, "b", 1), (1202, "x", None, 1), (1203, "x", "unknown", 1)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, DOCS)
    out = mixing.mix(df, targets)
    rows = out.collect()
    cap = {"a": 1, "b": 2, "c": 3}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.repeats <= cap[r.source] for r in rows)
    s = {r.source: r for r in mixing.shares(out, targets).collect()}
    assert all(abs(s[k].actual_share - s[k].target_share) < 0.005 for k in "abc") and s["absent"].tokens == 0
    assert mixing.mix(df.limit(0), targets).collect() == [] and mixing.mix(df, targets.limit(0)).collect() == []


def test_rates_minimise_relative_entropy(spark):
    from math import exp

    h = spark.createDataFrame([("s", 1, 5), ("s", 4, 3), ("s", 9, 2)], "source string, tokens int, n long")
    at = mixing.solve_rates(h, {"s": 60.0}, {"s": 3}, {"s": 3.5})["s"]
    rates = [min(3, exp(at * t / 3.5)) for t in (1, 4, 9)]
    assert abs(sum(n * t * r for n, t, r in zip((5, 3, 2), (1, 4, 9), rates)) - 60) < 1e-3


def test_token_counts(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([(1, "Hello world", "s", 1), (2, None, "s", 1), (3, "पद" * 500, "s", 1)], DOCS)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    e = tokens.encoding(tokens.TOKENIZER)
    assert got == {1: len(e.encode_ordinary("Hello world")), 2: 0, 3: len(e.encode_ordinary("पद" * 500))}
    assert e.decode(e.encode_ordinary("Hello पद world")) == "Hello पद world"
