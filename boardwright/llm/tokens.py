"""Token counts by a public byte-level tokenizer, read from a path in each Python worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public pattern that cuts a text into words before byte pairs are merged (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str = TOKENIZER, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens) of whole texts; null and empty texts have 0 tokens."""
    kept = documents.select(key, *keep, F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()]
            names = [key, *keep]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int32())], [*names, "n_tokens"])

    schema = kept.drop("_text").withColumn("n_tokens", F.lit(0)).schema
    return kept.mapInArrow(count, schema)
