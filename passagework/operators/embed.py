"""Embedding as a pluggable batched function; the deterministic embedder works offline."""

from __future__ import annotations

import asyncio
import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.runtime import ship


class Embedder(Protocol):
    """Anything that embeds a list of texts, one row for each."""

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...


class DeterministicEmbedder:
    """Unit vectors drawn from a generator seeded by the text's MD5 sum; equal texts have equal vectors."""

    def __init__(self, dim: int = 384, latency_ms: float = 0.0):
        self.dim, self.latency_ms = dim, latency_ms

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_texts([text])[0]

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        if self.latency_ms:
            time.sleep(self.latency_ms / 1000)
        out = np.empty((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            seed = int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16)
            v = np.random.RandomState(seed).randn(self.dim).astype(np.float32)
            out[i] = v / np.linalg.norm(v)
        return out


def concurrent_batches(run: Callable[[list], list], batches: list[list], mode: str, workers: int) -> list:
    """Results of all batches in their order: one after the other, in threads, or as limited coroutines."""
    if mode == "sequential":
        return [run(b) for b in batches]
    if mode == "threaded":
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(run, batches))
    if mode != "async":
        raise ValueError(f"unknown mode {mode!r}")

    async def all_() -> list:
        gate = asyncio.Semaphore(workers)
        loop = asyncio.get_running_loop()
        with ThreadPoolExecutor(workers) as pool:

            async def one(b: list):
                async with gate:
                    return await loop.run_in_executor(pool, run, b)

            return await asyncio.gather(*map(one, batches))

    return asyncio.run(all_())


def embed(texts: DataFrame, embedder: Embedder, key: str = "id", text: str = "text", batch: int = 256, mode: str = "sequential", workers: int = 8) -> DataFrame:
    """``key, embedding`` of every row; a null text is embedded as the empty one.

    Batches of ``batch`` texts go to the embedder, concurrently within a task if it waits for a
    service; the order of rows does not matter, vectors stay with their key.
    """
    if batch < 1:
        raise ValueError("batch must be positive")
    if mode not in ("sequential", "threaded", "async"):
        raise ValueError(f"unknown mode {mode!r}")
    ship(texts.sparkSession)
    rows = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).to_pylist()
            parts = concurrent_batches(embedder.embed_texts, [t[i : i + batch] for i in range(0, len(t), batch)], mode, workers)
            if not parts:
                continue
            x = np.concatenate(parts).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "embedding"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def embed_cached(texts: DataFrame, embedder: Embedder, path: str, key: str = "id", text: str = "text", batch: int = 256) -> DataFrame:
    """``key, embedding``; vectors of texts met before are taken from the table at ``path`` by the text's digest.

    Each run adds the new ones to it, so a changed text is embedded anew and a known one never again.
    """
    spark = texts.sparkSession
    rows = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    try:
        known = spark.read.parquet(path)
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        # nothing was kept so far
        known = None
    new = rows.groupBy("digest").agg(F.min("text").alias("text"))
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")
    embed(new, embedder, "digest", "text", batch).write.mode("append").parquet(path)
    return rows.select(key, "digest").join(spark.read.parquet(path).dropDuplicates(["digest"]), "digest").select(key, "embedding")
