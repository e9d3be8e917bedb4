"""Inverted-file index: build, statistics, storage, multi-probe search and probe sweeps."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import kmeans
from passagework.operators.search import BLOCK, _products, exact_topk, packed, top_k
from passagework.runtime import materialize, ship


class IVF:
    """``centroids`` (k, d) and ``postings`` (cluster_id, id, embedding, norm)."""

    def __init__(self, centroids: np.ndarray, postings: DataFrame):
        self.centroids, self.postings = centroids, postings

    @property
    def k(self) -> int:
        return len(self.centroids)


def build(index: DataFrame, k: int, iterations: int = 20, seed: int = 42, init: str = "random", start: np.ndarray | None = None) -> IVF:
    """Fit centroids (or take ``start`` after ``iterations`` steps) and assign every vector once more."""
    centroids = start if start is not None and iterations == 0 else kmeans.fit(index, k, iterations, seed, init=init, start=start).centroids
    near = kmeans.ranked_clusters(index, centroids, 1).select("id", "cluster_id")
    return IVF(centroids, near.join(index, "id").select("cluster_id", "id", "embedding", "norm"))


def build_timed(index: DataFrame, k: int, **options) -> tuple[IVF, float]:
    """An index whose postings are written, and the seconds that took."""
    began = time.perf_counter()
    made = build(index, k, **options)
    made.postings = materialize(made.postings, "postings")
    return made, time.perf_counter() - began


def posting_sizes(ivf: IVF) -> DataFrame:
    """``cluster_id, size`` of every cluster, empty ones too."""
    spark = ivf.postings.sparkSession
    every = spark.range(ivf.k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(ivf.postings.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")), "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def cluster_stats(ivf: IVF) -> DataFrame:
    """Smallest, largest, mean and population deviation of the cluster sizes."""
    return posting_sizes(ivf).agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.stddev_pop("size"), 6).alias("std_size"))


def save(ivf: IVF, path: str) -> None:
    """Postings partitioned by cluster, centroids and parameters beside them."""
    spark = ivf.postings.sparkSession
    ivf.postings.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/postings")
    rows = [(i, c.tolist()) for i, c in enumerate(ivf.centroids)]
    spark.createDataFrame(rows, "cluster_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> IVF:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()
    return IVF(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/postings"))


def probes(queries: DataFrame, ivf: IVF, n_probes: int) -> DataFrame:
    """``id, cluster_id, cluster_rank`` of the clusters that each query looks into."""
    return kmeans.ranked_clusters(queries, ivf.centroids, n_probes).select("id", "cluster_id", "cluster_rank")


def _candidates(queries: DataFrame, ivf: IVF, n_probes: int, k: int) -> DataFrame:
    """Best k of each cluster probed, scored as blocks of queries by blocks of postings.

    Probes are written before they are joined, with a filter on the cluster, so that a partitioned
    index is read only where it is probed.  Clusters come in parts of some ``BLOCK`` vectors.
    """
    ship(queries.sparkSession)
    asked = materialize(probes(queries, ivf, n_probes).join(queries, "id").select("cluster_id", "cluster_rank", "id", "embedding", "norm"), "probes").where("cluster_id >= 0")
    wanted = asked.select("cluster_id").distinct()
    postings = ivf.postings.join(wanted, "cluster_id", "left_semi")
    blocks = packed(postings, ["cluster_id"], BLOCK, "c")
    # a query block goes to each part of its cluster by number, so a cluster of any size is spread over tasks
    parts = postings.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    asking = packed(asked, ["cluster_id"], BLOCK, "q").join(parts, "cluster_id").withColumn("c_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    scored = asking.join(blocks, ["cluster_id", "c_part"]).select("q_id", "q_embedding", "q_norm", "c_id", "c_embedding", "c_norm").mapInArrow(_products(k), "query_id long, vec_id long, score double")
    return scored.withColumn("score", F.round("score", 6))


def search(queries: DataFrame, ivf: IVF, k: int = 10, n_probes: int = 8) -> DataFrame:
    """``query_id, rank, vec_id, score``; fewer rows where the probed clusters hold fewer vectors."""
    if k < 1:
        raise ValueError("k must be positive")
    return top_k(_candidates(queries, ivf, n_probes, k), ["query_id"], "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def sweep(queries: DataFrame, ivf: IVF, k: int, n_probes: list[int]) -> DataFrame:
    """``n_probes, query_id, rank, vec_id, score`` for several numbers of probes in one search.

    The clusters are ranked and their best k found once; each number of probes keeps what comes
    from clusters of lower rank.
    """
    if not n_probes or k < 1:
        raise ValueError("n_probes must not be empty and k must be positive")
    most = max(n_probes)
    best = materialize(_candidates(queries, ivf, most, k), "best")
    ranks = probes(queries, ivf, most).select(F.col("id").alias("query_id"), "cluster_id", "cluster_rank")
    home = ivf.postings.select(F.col("id").alias("vec_id"), "cluster_id")
    seen = best.join(home, "vec_id").join(ranks, ["query_id", "cluster_id"])
    spread = seen.withColumn("n_probes", F.explode(F.array(*[F.lit(p) for p in sorted(set(n_probes))]))).where("cluster_rank <= n_probes")
    return top_k(spread, ["n_probes", "query_id"], "score", "vec_id", k).select("n_probes", "query_id", "rank", "vec_id", "score")


def enough_probes(queries: DataFrame, corpus: DataFrame, ivf: IVF, k: int, recall: float) -> int:
    """Fewest probes, in steps of a sixteenth of the clusters, with which ``queries`` reach ``recall`` against exact search; at worst all."""
    steps = sorted({max(1, -(-ivf.k * i // 16)) for i in range(1, 17)})
    measured = recall_vs_exact(sweep(queries, ivf, k, steps), exact_topk(queries, corpus, k), ["n_probes"])
    good = [r["n_probes"] for r in measured.collect() if r["recall"] >= recall]
    return min(good, default=ivf.k)


def recall_vs_exact(found: DataFrame, exact: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of the exact neighbours that were found, as a mean over the queries."""
    by = by or []
    total = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))
    settings = found.select(*by).distinct() if by else None
    hit = found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("hit"))
    if by:
        total = total.withColumn("_s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.asDict().items()]) for r in settings.collect()]))).select("query_id", "all", "_s.*")
    each = total.join(hit, [*by, "query_id"], "left").withColumn("recall", F.coalesce("hit", F.lit(0)) / F.col("all"))
    return each.groupBy(*by).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("queries"))
