"""Exact top-k search of a query set against all vectors, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import vector
from passagework.runtime import ship

BLOCK = 2048
#: Vectors that a task of the block search holds; the queries pass by them once for each so many.
HELD = 1 << 14


def top_k(scored: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    """``rank`` 1..k in each group by score, then by lower ``tie``; NaN scores come last."""
    if k < 1:
        raise ValueError("k must be positive")
    clear = F.when(F.isnan(score), None).otherwise(F.col(score))
    order = Window.partitionBy(*group).orderBy(clear.desc_nulls_last(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def packed(vectors: DataFrame, key: list[str], size: int, prefix: str) -> DataFrame:
    """Vectors (id, embedding, norm) put together in blocks of about ``size``, several for each ``key``."""
    counts = vectors.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts")) if key else None
    if key:
        part = vectors.join(counts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    else:
        part = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-vectors.count() // size)))).cast("int"))
    rows = part.groupBy(*key, "part").agg(F.collect_list(F.struct("id", "embedding", "norm")).alias("_rows"))
    return rows.select(*key, F.col("part").alias(f"{prefix}_part"), *[F.col(f"_rows.{c}").alias(f"{prefix}_{c}") for c in ("id", "embedding", "norm")])


def _products(k: int):
    def matrix(values: pa.Array) -> np.ndarray:
        inner = values.values
        flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(inner), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = matrix(batch.column("q_embedding")[i]), matrix(batch.column("c_embedding")[i])
                nq, nc = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("q_norm", "c_norm"))
                iq, ic = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("q_id", "c_id"))
                scale = nq[:, None] * nc[None, :]
                s = np.divide(q @ c.T, scale, out=np.zeros(scale.shape), where=scale != 0)
                s = np.round(s, 12)
                order = np.argsort(ic, kind="stable")
                s, ic = s[:, order], ic[order]
                m = min(k, s.shape[1])
                if m < s.shape[1]:
                    kth = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                    r, at = np.nonzero(s >= kth[:, None] - 1e-6)  # ties at six decimals are told apart later
                else:
                    r, at = np.nonzero(np.ones(s.shape, bool))
                yield pa.RecordBatch.from_arrays([pa.array(iq[r]), pa.array(ic[at]), pa.array(s[r, at])], ["query_id", "vec_id", "score"])

    return run


def _beside(k: int):
    """Rows come by part, its vectors (``asks`` false) before its queries, which are multiplied as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, c = None, [], None

        def matrix(rows: pa.RecordBatch) -> np.ndarray:
            return rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)

        for batch in batches:
            parts, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])])) if len(parts) else np.zeros(0, int)
            for at, end in zip(cuts, [*cuts[1:], len(parts)]):
                rows = batch.slice(at, end - at)
                if parts[at] != part:
                    part, held, c = parts[at], [], None
                if not asks[at]:
                    held.append((rows.column("id").to_numpy(), matrix(rows), rows.column("norm").to_numpy()))
                    continue
                if not held:
                    continue
                if c is None:
                    ic, c, nc = (np.concatenate(x) for x in zip(*held))
                    held = [None]
                    order = np.argsort(ic, kind="stable")
                    ic, c, nc = ic[order], c[order], nc[order]
                m = min(k, len(ic))
                step = max(1, (1 << 20) // len(ic))
                for i in range(0, rows.num_rows, step):
                    some = rows.slice(i, step)
                    iq = some.column("id").to_numpy()
                    scale = some.column("norm").to_numpy()[:, None] * nc[None, :]
                    s = np.round(np.divide(matrix(some) @ c.T, scale, out=np.zeros(scale.shape), where=scale != 0), 12)
                    if m < s.shape[1]:
                        kth = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                        r, near = np.nonzero(s >= kth[:, None] - 1e-6)  # ties at six decimals are told apart later
                    else:
                        r, near = np.nonzero(np.ones(s.shape, bool))
                    yield pa.RecordBatch.from_arrays([pa.array(iq[r]), pa.array(ic[near]), pa.array(s[r, near])], ["query_id", "vec_id", "score"])

    return run


def _passed_by(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of the best ``k`` of each part of the corpus, and what ties with them."""
    parts = max(1, -(-corpus.count() // HELD))
    c = corpus.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "embedding", "norm")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "id", "embedding", "norm")
    return c.union(q).repartition("part").sortWithinPartitions("part", "asks").mapInArrow(_beside(k), "query_id long, vec_id long, score double")


def with_norm(vectors: DataFrame, node: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The index of an exact search: (id, embedding, norm), null ids and embeddings left out."""
    base = vectors.where(F.col(node).isNotNull() & F.col(embedding).isNotNull())
    return base.select(F.col(node).cast("long").alias("id"), F.col(embedding).alias("embedding"), vector.l2_norm(F.col(embedding)).alias("norm"))


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, strategy: str = "arrow", exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two indexes made by :func:`with_norm`.

    ``strategy`` "arrow" lets the queries pass by ``HELD`` vectors at a time as matrices, "expr" scores
    in column expressions through an equi-join; work is even, and blocks are never broadcast.
    A zero vector scores 0, ties go to the lower id, fewer than k vectors give fewer rows.
    """
    if strategy not in ("arrow", "expr"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if k < 1:
        raise ValueError("k must be positive")
    ship(corpus.sparkSession)
    more = k + int(exclude_self)
    if strategy == "arrow":
        scored = _passed_by(queries, corpus, more)
    else:
        parts = max(1, -(-corpus.count() // BLOCK))
        c = corpus.select(F.col("id").alias("vec_id"), "embedding", "norm", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
        q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("nq"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        scored = q.join(c, "part").select("query_id", "vec_id", F.round(vector.cosine(F.col("q"), F.col("embedding"), F.col("nq"), F.col("norm")), 12).alias("score"))
    if exclude_self:
        scored = scored.where("query_id <> vec_id")
    scored = scored.withColumn("score", F.round("score", 6))
    return top_k(scored, ["query_id"], "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def block_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``query_id, vec_id, score`` of every query against every vector, by block products."""
    ship(corpus.sparkSession)
    return _passed_by(queries, corpus, 1 << 62)


#: Kernels of the exact search by name, as (strategy, whether stored norms are used).
KERNELS = {"columns": ("expr", False), "columns, stored norms": ("expr", True), "blocks": ("arrow", False), "blocks, stored norms": ("arrow", True)}


def by_kernel(name: str, queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """:func:`exact_topk` by one of ``KERNELS``."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}")
    strategy, stored = KERNELS[name]
    if not stored:
        queries, corpus = (x.withColumn("norm", vector.l2_norm(F.col("embedding"))) for x in (queries, corpus))
    return exact_topk(queries, corpus, k, strategy)


def scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``query_id, vec_id, score`` of every query against every vector."""
    parts = max(1, -(-corpus.count() // BLOCK))
    c = corpus.select(F.col("id").alias("vec_id"), "embedding", "norm", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("nq"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return q.join(c, "part").select("query_id", "vec_id", vector.cosine(F.col("q"), F.col("embedding"), F.col("nq"), F.col("norm")).alias("score"))
