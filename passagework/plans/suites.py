"""Suites that time the engine's parts side by side; each gives one row for every variant.

Times differ from run to run, so suites are no queries of the catalogue; what they compute is.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators import embed, experiments, generate, ivf, search
from passagework.plans import pipelines


def _suite(corpus: DataFrame, runs: dict[str, Callable[[], DataFrame]], component: str, repeats: int) -> DataFrame:
    first = corpus.select(F.size("embedding").alias("d")).head()
    return pipelines.benchmark(corpus.sparkSession, runs, component, corpus.count(), first["d"] if first else 0, 1, repeats)


def kernels(queries: DataFrame, corpus: DataFrame, k: int = 10, repeats: int = 3) -> DataFrame:
    """Every kernel of the exact search; norms stored or made anew."""
    return _suite(corpus, {n: lambda n=n: search.by_kernel(n, queries, corpus, k) for n in search.KERNELS}, "kernel", repeats)


def searches(queries: DataFrame, corpus: DataFrame, index: ivf.IVF, probes: list[int], k: int = 10, repeats: int = 3) -> DataFrame:
    """Exact search against the inverted file at several numbers of probes."""
    runs = {"exact": lambda: search.exact_topk(queries, corpus, k)}
    runs.update({f"inverted file, {p} probes": lambda p=p: ivf.search(queries, index, k, p) for p in probes})
    out = _suite(corpus, runs, "search", repeats)
    return experiments.speedup(out, [], F.col("name") == "exact", "mean_ms")


def builds(corpus: DataFrame, clusters: list[int], iterations: int = 5) -> DataFrame:
    """``name, k, seconds, smallest, largest`` of builds by both ways to choose the first centroids."""
    rows = []
    for init in ("random", "k-means++"):
        for k in clusters:
            began = time.perf_counter()
            made = ivf.build(corpus, k, iterations, init=init)
            stats = ivf.cluster_stats(made).collect()[0]
            rows.append((init, k, time.perf_counter() - began, stats["min_size"], stats["max_size"]))
    return corpus.sparkSession.createDataFrame(rows, "name string, k int, seconds double, smallest long, largest long")


def ablation(queries: DataFrame, corpus: DataFrame, index: ivf.IVF, probes: list[int], k: int = 10, repeats: int = 1) -> DataFrame:
    """Kernels of the exact search and probes of the inverted file in one table, against the plainest kernel."""
    runs = {n: lambda n=n: search.by_kernel(n, queries, corpus, k) for n in search.KERNELS}
    runs.update({f"inverted file, {p} probes": lambda p=p: ivf.search(queries, index, k, p) for p in probes})
    return experiments.speedup(_suite(corpus, runs, "ablation", repeats), [], F.col("name") == "columns", "mean_ms")


def embeddings(texts: DataFrame, embedder: embed.Embedder, batches: list[int], key: str = "id", repeats: int = 1) -> DataFrame:
    """Embedding in batches of several sizes, one after the other, in threads and as coroutines."""
    n = texts.count()
    runs = {f"{mode}, {b}": lambda b=b, mode=mode: embed.embed(texts, embedder, key, batch=b, mode=mode) for b in batches for mode in ("sequential", "threaded", "async")}
    return pipelines.benchmark(texts.sparkSession, runs, "embedding", n, 0, 0, repeats)


def generations(items: DataFrame, generator: generate.Generator, workers: list[int], repeats: int = 1) -> DataFrame:
    """Answers one after the other, and in threads or as coroutines with several numbers of workers."""
    runs = {"sequential": lambda: generate.generate(items, generator, batch=1)}
    runs.update({f"{mode}, {w}": lambda w=w, mode=mode: generate.generate(items, generator, batch=1, mode=mode, workers=w) for w in workers for mode in ("threaded", "async")})
    out = pipelines.benchmark(items.sparkSession, runs, "generation", items.count(), 0, 0, repeats)
    return experiments.speedup(out, [], F.col("name") == "sequential", "mean_ms")


def first_tokens(items: DataFrame, generator) -> DataFrame:
    """``mean_ttft_ms, mean_total_ms, share`` of answers that come as streams of tokens."""
    s = generate.generate_streams(items, generator)
    return s.agg(F.avg("ttft_ms").alias("mean_ttft_ms"), F.avg("total_ms").alias("mean_total_ms"), F.avg(F.col("ttft_ms") / F.col("total_ms")).alias("share"))


def combinations(indexes: tuple[str, ...] = ("exact", "ivf"), strategies: tuple[str, ...] = ("expr", "arrow"), modes: tuple[str, ...] = ("sequential", "threaded", "async")) -> tuple[pipelines.Config, ...]:
    """Every index, kernel and way to call the generator; the inverted file has one kernel."""
    return tuple(pipelines.Config(f"{i}, {s}, {m}", i, s, mode=m) for i in indexes for s in (strategies if i == "exact" else ("arrow",)) for m in modes)


def end_to_end(queries: DataFrame, corpus: DataFrame, index: ivf.IVF, texts: DataFrame, configs: tuple[pipelines.Config, ...] | None = None) -> DataFrame:
    """:func:`pipelines.compare` over a grid of configurations, with the fastest marked."""
    out = pipelines.compare(queries, corpus, index, texts, configs or combinations())
    best = out.agg(F.min_by("name", "total_ms").alias("n")).collect()[0]["n"]
    return out.withColumn("best", F.col("name") == best)


def overlapped(queries: DataFrame, corpus: DataFrame, index: ivf.IVF, texts: DataFrame, config: pipelines.Config) -> DataFrame:
    """``name, total_ms, speedup``: search written before generation begins, against both as stages of one plan."""
    from passagework.runtime import materialize

    def apart() -> DataFrame:
        q = queries.select("id", "embedding", "norm")
        hits = materialize(ivf.search(q, index, 3, min(config.n_probes, index.k)) if config.index == "ivf" else search.exact_topk(q, corpus, 3, config.strategy), "hits")
        return pipelines.answered(queries, hits, texts, config)

    rows = [(n, min(pipelines.timed(f, 0, 1))) for n, f in (("one after the other", apart), ("one plan", lambda: pipelines.answer(queries, corpus, index, texts, config)))]
    df = corpus.sparkSession.createDataFrame(rows, "name string, total_ms double")
    return experiments.speedup(df, [], F.col("name") == "one after the other", "total_ms")
