"""Token counts by a public tokenizer whose rank file is given by path."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.runtime import ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, node: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """``doc_id, tokens`` of each document; a null or empty text has 0 tokens, rows without id are left out.

    Rows repeated under one id count once, with the most tokens.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(node).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(_counts(path), "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
