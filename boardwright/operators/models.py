"""Naive Bayes, word vectors and nearest neighbours as relational operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def train_bayes(examples: DataFrame, features: str, label: str, alpha: float = 1.0, ratio: int | None = None, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(priors, weights) of a two-class multinomial model; label is a boolean column, features an array of strings.

    priors: one row (n_pos, n_neg, prior_pos, prior_neg); weights: (feature, lp_pos, lp_neg). Negatives are thinned to
    about ``ratio`` times the positives by the hash of key, so the same rows are taken on every run and cluster.
    """
    base = examples.filter(F.col(label).isNotNull())
    if ratio is not None:
        n = base.agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n")).first()
        share = min(1.0, ratio * n.p / n.n) if n.n else 1.0
        base = base.filter(F.col(label) | (F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)))
    classes = base.agg(F.count_if(F.col(label)).alias("n_pos"), F.count_if(~F.col(label)).alias("n_neg"))
    total = F.col("n_pos") + F.col("n_neg") + 2
    priors = classes.select("n_pos", "n_neg", F.log((F.col("n_pos") + 1) / total).alias("prior_pos"), F.log((F.col("n_neg") + 1) / total).alias("prior_neg"))
    flat = base.select(F.col(label).alias("y"), F.explode(features).alias("feature"))
    counts = flat.groupBy("feature").agg(F.count_if(F.col("y")).alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    sums = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count("*").alias("v"))
    joined = counts.join(F.broadcast(sums))  # one row
    lp = lambda c: F.log((F.col(c) + alpha) / (F.col(f"all_{c}") + alpha * F.col("v"))).alias(f"lp_{c}")
    return priors, joined.select("feature", lp("pos"), lp("neg"))


def predict_bayes(rows: DataFrame, features: str, key: str, priors: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, margin): log-odds of the positive class. Unknown features are ignored; rows without known ones have the prior's."""
    known = rows.select(key, F.explode(features).alias("feature")).join(weights, "feature")
    sums = known.groupBy(key).agg(F.sum(F.col("lp_pos") - F.col("lp_neg")).alias("s"))
    base = rows.select(key).join(sums, key, "left").join(F.broadcast(priors))  # one row
    return base.select(key, (F.col("prior_pos") - F.col("prior_neg") + F.coalesce("s", F.lit(0.0))).alias("margin"))


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, dim, mean): mean vector of each group in long form, partially aggregated per task."""
    return vectors.select(group, F.posexplode(vec).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def packed_centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    long = centroids(vectors, group, vec).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("x"))
    return long.select(group, F.transform("x", lambda s: s["mean"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def nearest(queries: DataFrame, points: DataFrame, key: str, vec: str, k: int, most_queries: int = 10_000) -> DataFrame:
    """(query, rank, key, cosine) of the k nearest other points of each query.

    A stated set of queries against all points: the queries are broadcast in blocks of about most_queries, and each
    partition of points keeps its k best per query before the shuffle. Ties go by key; rows without a vector are left out.
    """
    queries = queries.filter(F.col(vec).isNotNull())
    number = queries.count()
    blocks = -(-number // most_queries)
    if blocks > 1:
        parts = [queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) for i in range(blocks)]
        return reduce(lambda a, b: a.unionByName(b), [_nearest(p, points, key, vec, k) for p in parts])
    return _nearest(queries, points, key, vec, k)


def _nearest(queries: DataFrame, points: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    rows = queries.select(key, vec).collect()  # one block
    spark = points.sparkSession
    schema = "query long, key long, cosine double"
    if not rows:
        return spark.createDataFrame([], "query long, rank int, key long, cosine double")
    ids = np.array([r[0] for r in rows], np.int64)
    q = np.array([r[1] for r in rows], np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast((ids, q))

    def best(batches):
        ids, q = shared.value
        held_c, held_k = np.full((len(ids), 0), -2.0), np.full((len(ids), 0), 0, np.int64)
        for b in batches:
            x = np.array(b.column("v").to_pylist(), np.float64)
            if not len(x):
                continue
            own = b.column("key").to_numpy()
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            c = q @ x.T
            c[ids[:, None] == own[None, :]] = -2.0
            c, n = np.hstack([held_c, c]), np.hstack([held_k, np.broadcast_to(own, c.shape)])
            order = np.lexsort((n, -np.round(c, 12)), axis=1)[:, :k]
            held_c, held_k = np.take_along_axis(c, order, 1), np.take_along_axis(n, order, 1)
        query = np.repeat(ids, held_c.shape[1])
        ok = held_c.ravel() > -1.5
        yield pa.RecordBatch.from_arrays([pa.array(query[ok]), pa.array(held_k.ravel()[ok]), pa.array(held_c.ravel()[ok])], ["query", "key", "cosine"])

    found = points.filter(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("v")).mapInArrow(best, schema)
    w = W.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "key", "cosine")


def word_pairs(tokens: DataFrame, key: str, words: str, window: int = 2) -> DataFrame:
    """(word, context, n): skip-gram pairs within ``window`` positions, counted in the JVM without a join."""
    at = F.posexplode(words).alias("i", "word")
    flat = tokens.select(words, at)
    lo = F.greatest(F.col("i") - window, F.lit(0))
    near = F.explode(F.slice(F.col(words), lo + 1, F.col("i") + window - lo + 1)).alias("context")
    pairs = flat.select("word", near).groupBy("word", "context").agg(F.count("*").alias("n"))
    return pairs.filter("word != context")


def title_vectors(titles: DataFrame, key: str, tokens: str, embeddings: DataFrame, profile: tuple[str, ...], weight: float = 2.0) -> DataFrame:
    """(key, x): weighted mean of the vectors of a title's words, words of the profile counting ``weight`` times.

    embeddings: (word, vec), joined by word; titles without a known word have no row. A title's words are folded at once.
    """
    counted = titles.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    w = F.col("tf") * F.when(F.col("word").isin(*profile), F.lit(weight)).otherwise(F.lit(1.0))
    known = counted.join(embeddings, "word").select(key, F.struct("word", w.alias("w"), F.transform("vec", lambda x: x.cast("double")).alias("v")).alias("e"))
    each = known.groupBy(key).agg(F.sum("e.w").alias("sum"), F.array_sort(F.collect_list("e")).alias("es"))  # at most a title's words, in one order
    scaled = F.transform("es", lambda e: F.transform(e["v"], lambda x: x * e["w"]))
    zero = F.transform(F.get(scaled, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(scaled, zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return each.select(key, "sum", total.alias("t")).select(key, F.transform("t", lambda x: x / F.col("sum")).alias("x"))


def profile_similarity(titles: DataFrame, key: str, tokens: str, embeddings: DataFrame, wanted: tuple[str, ...], unwanted: tuple[str, ...]) -> DataFrame:
    """(key, wanted, unwanted): cosines of a title's vector to the mean vectors of two profiles; 0 where a profile or a title has no known word.

    The profiles are word lists of the caller, their means become literals.
    """
    rows = embeddings.filter(F.col("word").isin(*wanted, *unwanted)).groupBy("word").agg(F.first("vec").alias("vec")).collect()  # at most the profiles' words

    def mean(words: tuple[str, ...]) -> list[float]:
        own = [[float(x) for x in r.vec] for r in sorted(rows) if r.word in words]
        return [sum(c) / len(own) for c in zip(*own)]

    vectors = title_vectors(titles, key, tokens, embeddings, (*wanted, *unwanted))
    to = lambda m: cosine(F.col("x"), F.array(*[F.lit(v) for v in m])) if m else F.lit(0.0)
    known = vectors.select(key, to(mean(wanted)).alias("wanted"), to(mean(unwanted)).alias("unwanted"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return titles.select(key).join(known, key, "left").select(key, zero("wanted"), zero("unwanted"))


def train_word_vectors(titles: DataFrame, tokens: str, size: int = 16, window: int = 2, least: int = 2, rounds: int = 5, seed: int = 42) -> DataFrame:
    """(word, vec): skip-gram vectors of the words that occur at least ``least`` times (hierarchical softmax in place of negative samples)."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol=tokens, outputCol="_v").fit(titles.filter(F.size(tokens) > 1))
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vec"))


def subset_embeddings(embeddings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Embeddings of the words in the vocabulary (word)."""
    return embeddings.join(vocabulary.select("word").distinct(), "word", "left_semi")


def max_similarity(titles: DataFrame, key: str, tokens: str, embeddings: DataFrame, profile: list[str]) -> DataFrame:
    """(key, word, profile_word, cosine): the closest pair of a title's word and a profile word; ties go by word.

    The profile is a word list of the caller, its vectors become literals; words are scored once each, not per title.
    """
    rows = embeddings.filter(F.col("word").isin(*profile)).dropDuplicates(["word"]).collect()  # at most the profile's words
    wanted = F.array(*[F.struct(F.lit(r.word).alias("profile_word"), F.array(*[F.lit(float(x)) for x in r.vec]).alias("pv")) for r in rows])
    words = titles.select(F.explode(tokens).alias("word")).distinct().join(embeddings, "word")
    each = words.select("word", "vec", F.explode(wanted).alias("p"))
    scored = each.select("word", "p.profile_word", cosine(F.col("vec"), F.col("p.pv")).alias("cosine"))
    best = scored.groupBy("word").agg(F.max_by(F.struct("profile_word", "cosine"), F.struct("cosine", "profile_word")).alias("b")).select("word", "b.*")
    flat = titles.select(key, F.explode(tokens).alias("word")).distinct().join(best, "word")
    return flat.groupBy(key).agg(F.max_by(F.struct("word", "profile_word", "cosine"), F.struct("cosine", "word")).alias("b")).select(key, "b.*")
