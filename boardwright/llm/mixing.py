"""Mixing sources to target weights by entropy balancing.

The rates closest in relative entropy to one use of each document, under the sources' token targets and the cap on
repeats, are min(cap, exp(lambda * tokens / mean)). Newton iterations on the convex dual find lambda of all sources
at once; each iteration is one distributed aggregate over the exact histogram of (source, tokens). Rates are
rounded into copies by carrying the rounding error, in tokens, from length to length.
"""

from __future__ import annotations

from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwright.llm.ranks import ranked
from boardwright.llm.tokens import TOKENIZER, count_tokens
from boardwright.session import materialize

#: Share of the largest reachable total that the mixture takes.
FILL = 0.9


def _by_source(values: dict[str, float]) -> Column:
    """A column with the value of the row's source (sources are a handful)."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("source")]


def solve_rates(histogram: DataFrame, goal: dict[str, float], cap: dict[str, int], mean: dict[str, float], rounds: int = 60, tolerance: float = 1e-7) -> dict[str, float]:
    """lambda of each source, by safeguarded Newton steps: a step that leaves the bracket is replaced by its middle."""
    low, high = dict.fromkeys(goal, -700.0), dict.fromkeys(goal, 700.0)
    at = dict.fromkeys(goal, 0.0)
    for _ in range(rounds):
        x = F.col("tokens") / _by_source(mean)
        tilt = _by_source(at) * x
        free = tilt < _by_source({s: log(c) for s, c in cap.items()})
        rate = F.when(free, F.exp(tilt)).otherwise(_by_source({s: float(c) for s, c in cap.items()}))
        mass = F.col("n") * F.col("tokens") * rate
        sums = histogram.groupBy("source").agg(F.sum(mass).alias("f"), F.sum(F.when(free, mass * x).otherwise(0.0)).alias("g")).collect()
        worst = 0.0
        for r in sums:
            s, miss = r.source, r.f - goal[r.source]
            worst = max(worst, abs(miss) / goal[s])
            (high if miss > 0 else low)[s] = at[s]
            step = at[s] - miss / r.g if r.g > 0 else None
            at[s] = step if step is not None and low[s] < step < high[s] else (low[s] + high[s]) / 2
        if worst < tolerance:
            break
    return at


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, fill: float = FILL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, n_tokens, repeats) of the documents chosen, each at most max_repeats times.

    The total is ``fill`` times the largest at which every source can reach its share. Texts without tokens, and
    sources without a target or with a share or cap of zero, are left out; so are targets of sources without texts.
    """
    spark = documents.sparkSession
    wanted = {r.source: (r.share, r.cap) for r in targets.filter("target_share > 0 and max_repeats > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect()}
    sized = count_tokens(documents, tokenizer, key, text, keep=("source",)).withColumnRenamed(key, "id")
    sized = materialize(sized.filter(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0)), "sizes")
    histogram = sized.groupBy("source", F.col("n_tokens").alias("tokens")).agg(F.count("*").alias("n"))
    histogram = materialize(histogram, "histogram")
    sums = {r.source: r for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    wanted = {s: w for s, w in wanted.items() if s in sums}
    if not wanted:
        return spark.createDataFrame([], f"{key} long, source string, n_tokens int, repeats int")
    whole = sum(share for share, _ in wanted.values())
    total = fill * min(cap * sums[s].t / (share / whole) for s, (share, cap) in wanted.items())
    goal = {s: total * share / whole for s, (share, _) in wanted.items()}
    cap = {s: c for s, (_, c) in wanted.items()}
    mean = {s: sums[s].t / sums[s].n for s in wanted}
    tilt = solve_rates(histogram, goal, cap, mean)

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's lengths, longest first, so that short texts settle the rest: whole copies for all, one more for the first ``extra`` by rank."""
        pdf = pdf.sort_values("tokens", ascending=False)
        base, extra, carry = [], [], 0.0
        for s, t, n in zip(pdf["source"], pdf["tokens"], pdf["n"]):
            power = tilt[s] * t / mean[s]
            rate = float(cap[s]) if power >= log(cap[s]) else exp(power)
            carry += n * t * (rate - int(rate))
            more = min(n, max(0, round(carry / t))) if int(rate) < cap[s] else 0
            carry -= more * t
            base.append(int(rate))
            extra.append(more)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["tokens"], "base": base, "extra": extra})

    copies = histogram.groupBy("source").applyInPandas(rounded, "source string, n_tokens int, base int, extra long")
    order = ranked(sized, ["source", "n_tokens"], F.struct(F.xxhash64("id"), "id"), sum(r.n for r in sums.values()))
    repeats = (F.col("base") + (F.col("rank") < F.col("extra")).cast("int")).alias("repeats")
    out = order.join(copies, ["source", "n_tokens"]).select(F.col("id").alias(key), "source", "n_tokens", repeats)
    return out.filter("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats) of each target; sources not met have 0."""
    mixed = materialize(mixed, "mixed")
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = used.agg(F.sum("tokens")).first()[0] or 1  # one number
    goal = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    both = goal.join(F.broadcast(used), "source", "left")  # a handful of rows
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("documents"), zero("most_repeats"))
