"""K-Means by cosine with arithmetic means: driver loop, partial sums on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions import vector
from passagework.operators.numbering import running_number
from passagework.runtime import materialize, ship

#: Centroids are handed to every task; more than this many numbers are refused.
CENTROID_LIMIT = 1 << 24


@dataclass
class Fit:
    centroids: np.ndarray
    iterations: int
    shift: float


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("embedding")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def similarities(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines of rows and centroids; 0 where either is a zero vector."""
    scale = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((centroids * centroids).sum(axis=1))[None, :]
    return np.round(np.divide(x @ centroids.T, scale, out=np.zeros(scale.shape), where=scale != 0), 12)


def _sums(centroids: np.ndarray):
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d)), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch)
            a = similarities(x, centroids).argmax(axis=1)
            np.add.at(total, a, x)
            count += np.bincount(a, minlength=k)
        hit = np.flatnonzero(count)
        for i in range(0, len(hit), 1024):
            h = hit[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), pa.array(count[h]), pa.array(total[h].tolist(), pa.list_(pa.float64()))], ["cluster_id", "n", "total"])

    return run


def step(index: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the vectors nearest to each centroid: partial sums, added up by dimension."""
    ship(index.sparkSession)
    k, d = centroids.shape
    parts = index.select("embedding").mapInArrow(_sums(centroids), "cluster_id int, n long, total array<double>")
    added = parts.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.element_at("total", i + 1)) for i in range(d)]).alias("total"))
    sums, counts = np.zeros((k, d)), np.zeros(k, np.int64)
    for r in added.collect():  # one row for each centroid
        sums[r["cluster_id"]], counts[r["cluster_id"]] = r["total"], r["n"]
    return sums, counts


def seeds(index: DataFrame, k: int, seed: int = 42, init: str = "random") -> np.ndarray:
    """First centroids: ``k`` vectors drawn without replacement, or by k-means++."""
    if init not in ("random", "k-means++"):
        raise ValueError(f"unknown init {init!r}")
    n = index.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be in 1..{n}")
    numbered = running_number(index.select("id", "embedding"), ["id"], "_n")
    rng = np.random.default_rng(seed)

    def take(at: list[int]) -> np.ndarray:
        rows = {r["_n"]: r["embedding"] for r in numbered.where(F.col("_n").isin(at)).select("_n", "embedding").collect()}
        return np.array([rows[i] for i in at], dtype=np.float64)

    if init == "random":
        return take([int(i) for i in rng.choice(n, k, replace=False)])
    chosen = take([int(rng.integers(n))])
    mass = materialize(numbered.withColumn("d2", F.lit(float("inf"))), "mass")
    for _ in range(1, k):
        last = F.array(*[F.lit(float(v)) for v in chosen[-1]])
        mass = materialize(mass.withColumn("d2", F.least("d2", vector.sq_distance(F.col("embedding"), last))), "mass")
        # the draw first picks a block by its mass, then a vector in it
        blocks = mass.groupBy(F.floor(F.col("_n") / 4096).alias("b")).agg(F.sum("d2").alias("m")).orderBy("b").collect()
        total = sum(b["m"] for b in blocks)
        if total <= 0:
            chosen = np.concatenate([chosen, take([int(rng.integers(n))])])
            continue
        u, at = rng.random() * total, 0
        while at < len(blocks) - 1 and u >= blocks[at]["m"]:
            u -= blocks[at]["m"]
            at += 1
        rows = mass.where(F.floor(F.col("_n") / 4096) == blocks[at]["b"]).orderBy("_n").select("_n", "d2").collect()
        running = np.cumsum([r["d2"] for r in rows])
        chosen = np.concatenate([chosen, take([int(rows[min(int(np.searchsorted(running, u, side="right")), len(rows) - 1)]["_n"])])])
    return chosen


def fit(index: DataFrame, k: int, iterations: int = 20, seed: int = 42, tolerance: float = 1e-6, init: str = "random", start: np.ndarray | None = None) -> Fit:
    """Assign by cosine, move to the mean, until the centroids stay or ``iterations`` are over.

    A centroid without vectors moves to a random vector.  ``index`` has (id, embedding).
    """
    index = materialize(index.select("id", "embedding"), "vectors")
    centroids = seeds(index, k, seed, init) if start is None else np.asarray(start, dtype=np.float64)
    if centroids.size > CENTROID_LIMIT:
        raise ValueError("too many centroids to hand to every task")
    rng = np.random.default_rng(seed)
    shift = 0.0
    for i in range(iterations):
        sums, counts = step(index, centroids)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        dead = np.flatnonzero(counts == 0)
        if len(dead):
            numbered = running_number(index, ["id"], "_n")
            at = [int(rng.integers(index.count())) for _ in dead]
            rows = {r["_n"]: r["embedding"] for r in numbered.where(F.col("_n").isin(at)).collect()}
            for c, j in zip(dead, at):
                new[c] = rows[j]
        shift = float(np.sqrt(((new - centroids) ** 2).sum()))
        centroids = new
        if shift < tolerance:
            return Fit(centroids, i + 1, shift)
    return Fit(centroids, iterations, shift)


def ranked_clusters(index: DataFrame, centroids: np.ndarray, top: int) -> DataFrame:
    """``id, cluster_id, cluster_rank, score`` of the ``top`` most similar centroids, ties to the lower id."""
    if not 1 <= top <= len(centroids):
        raise ValueError(f"top must be in 1..{len(centroids)}")
    if centroids.size > CENTROID_LIMIT:
        raise ValueError("too many centroids to hand to every task")
    ship(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = similarities(_rows(batch), centroids)
            order = np.argsort(-s, axis=1, kind="stable")[:, :top]
            n = len(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.arange(n), top))), pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, top + 1), n), pa.int32()), pa.array(np.take_along_axis(s, order, 1).ravel())],
                ["id", "cluster_id", "cluster_rank", "score"],
            )

    return index.select("id", "embedding").mapInArrow(run, "id long, cluster_id int, cluster_rank int, score double")


def lloyd_step(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster_id, dim, value, moved`` after one step, in SQL terms."""
    assigned = ranked_clusters(index, centroids, 1).select("id", "cluster_id").join(index.select("id", "embedding"), "id")
    spread = assigned.select("cluster_id", F.posexplode("embedding").alias("dim", "x"))
    return spread.groupBy("cluster_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def first_rows(index: DataFrame, k: int) -> np.ndarray:
    """The vectors of the ``k`` lowest ids, as fixed seeds."""
    rows = index.orderBy("id").limit(k).select("embedding").collect()
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


__all__ = ["Fit", "fit", "first_rows", "lloyd_step", "ranked_clusters", "seeds", "similarities", "step"]
