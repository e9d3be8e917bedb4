"""From passages to answers: building a knowledge base, timing its stages, comparing configurations."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import embed, evaluate, experiments, generate, ivf, numbering, search
from passagework.runtime import materialize
from passagework.schema import BENCHMARK
from passagework.sources import tables


def timed(run: Callable[[], DataFrame], warmups: int = 1, repeats: int = 3) -> list[float]:
    """Milliseconds of each repeat; results are computed in full and thrown away."""
    out = []
    for i in range(warmups + repeats):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i >= warmups:
            out.append((time.perf_counter() - began) * 1000)
    return out


def benchmark(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]], component: str, n_vectors: int, dimension: int, warmups: int = 1, repeats: int = 3) -> DataFrame:
    """One row for each run: name, component, sizes, times and their mean, deviation, median and minimum."""
    rows = [(name, component, n_vectors, dimension, timed(run, warmups, repeats)) for name, run in runs.items()]
    df = spark.createDataFrame(rows, BENCHMARK)
    long = df.select("name", F.explode("times_ms").alias("ms"))
    return df.join(long.groupBy("name").agg(*evaluate.latency_columns(F.col("ms"))), "name")


def preprocess(passages: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """Chunks (id, text, source_id, ordinal) of passages (ordinal, id, text), cleaned and numbered."""
    cleaned = passages.where("text is not null").select("ordinal", F.col("id").alias("source_id"), T.clean_text(F.col("text")).alias("text"))
    pieces = cleaned.select("ordinal", "source_id", F.posexplode(T.chunk_text(F.col("text"), size, overlap)).alias("pos", "text"))
    return numbering.running_number(pieces, ["ordinal", "pos"]).select(F.concat(F.lit("chunk_"), "n").alias("id"), "text", "source_id", F.col("n").alias("ordinal"))


@dataclass
class Config:
    """Which index is searched, and how the generator is called."""

    name: str
    index: str = "exact"
    strategy: str = "arrow"
    n_probes: int = 8
    mode: str = "sequential"
    workers: int = 8
    generator: generate.Generator = field(default_factory=generate.SimulatedGenerator)

    def __post_init__(self) -> None:
        if self.index not in ("exact", "ivf") or self.strategy not in ("arrow", "expr") or self.mode not in ("sequential", "threaded", "async"):
            raise ValueError(f"unknown index, strategy or mode in {self}")


#: The configurations that are compared: plain, and with index and concurrency one after the other.
CONFIGS = (Config("exact, expressions, one by one", strategy="expr"), Config("exact, blocks, one by one"), Config("inverted file, one by one", "ivf"), Config("inverted file, threads", "ivf", mode="threaded"), Config("inverted file, async", "ivf", mode="async"))


def build_knowledge_base(passages: DataFrame, path: str, embedder: embed.Embedder, clusters: int | None = None, iterations: int = 5) -> DataFrame:
    """Chunks, vectors and an inverted file below ``path``; returns the seconds of each stage and row counts.

    Each stage is written and read again, so a stage that fails leaves those before it in place.
    """
    spark = passages.sparkSession
    stages: list[tuple[str, float, int]] = []

    def stage(name: str, run: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        run().write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        out = spark.read.parquet(f"{path}/{name}.parquet")
        stages.append((name, time.perf_counter() - began, out.count()))
        return out

    stage("passages", lambda: passages)
    chunks = stage("chunks", lambda: preprocess(passages))
    vectors = stage("vectors", lambda: embed.embed(chunks.select(F.col("ordinal").alias("vec_id"), "text"), embedder, "vec_id").join(chunks.select(F.col("ordinal").alias("vec_id"), F.col("id").alias("chunk_id")), "vec_id"))
    began = time.perf_counter()
    n = vectors.count()
    k = clusters or spark.range(1).select(T.auto_clusters(F.lit(n)).alias("k")).collect()[0]["k"]
    ivf.save(ivf.build(search.with_norm(vectors), min(k, n), iterations), f"{path}/ivf")
    stages.append(("ivf", time.perf_counter() - began, n))
    return spark.createDataFrame(stages, "stage string, seconds double, rows long")


def answer(queries: DataFrame, corpus: DataFrame, index: ivf.IVF | None, texts: DataFrame, config: Config, k: int = 3) -> DataFrame:
    """``id, answer, prompt_tokens`` of queries (id, text, embedding, norm): search, contexts in the budget, generation.

    Search and generation are stages of one plan: rows go on to the generator as soon as the blocks
    before them are done, which is how retrieval and generation overlap.
    """
    q = queries.select("id", "embedding", "norm")
    hits = search.exact_topk(q, corpus, k, config.strategy) if config.index == "exact" else ivf.search(q, index, k, min(config.n_probes, index.k))
    return answered(queries, hits, texts, config)


def answered(queries: DataFrame, hits: DataFrame, texts: DataFrame, config: Config) -> DataFrame:
    """``id, answer, prompt_tokens`` from ranked hits (query_id, rank, vec_id)."""
    found = hits.join(texts.select(F.col("id").alias("vec_id"), "text"), "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    kept = generate.budgeted(found, ["query_id"], ["rank"]).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]).alias("contexts"))
    items = queries.select("id", "text").join(kept.withColumnRenamed("query_id", "id"), "id", "left")
    return generate.generate(items, config.generator, mode=config.mode, workers=config.workers)


def compare(queries: DataFrame, corpus: DataFrame, index: ivf.IVF, texts: DataFrame, configs: tuple[Config, ...] = CONFIGS) -> DataFrame:
    """``name, total_ms, queries, per_second, speedup`` of each configuration, against the first."""
    spark = corpus.sparkSession
    queries, corpus = materialize(queries, "queries"), materialize(corpus, "corpus")
    n = queries.count()
    rows = []
    for c in configs:
        ms = min(timed(lambda c=c: answer(queries, corpus, index, texts, c), 0, 1))
        rows.append((c.name, ms, n, n / max(ms, 1e-9) * 1000))
    df = spark.createDataFrame(rows, "name string, total_ms double, queries long, per_second double")
    return experiments.speedup(df, [], F.col("name") == configs[0].name, "total_ms")


def report(df: DataFrame, path: str) -> None:
    tables.write_report(df, path)
