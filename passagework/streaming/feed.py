"""Queries that arrive as a stream, answered against an index; stateless, so order and retries do no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from passagework.operators import ivf as _ivf
from passagework.operators.search import exact_topk
from passagework.runtime import shared_dir


def answer_stream(arriving: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Answers every micro-batch of queries and writes it under its number, so that a retry overwrites."""

    def one(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def exact_feed(arriving: DataFrame, corpus: DataFrame, k: int, name: str, exclude_self: bool = False) -> DataFrame:
    """All answers to a stream that ends, by exact search."""
    return _run(arriving, lambda q: exact_topk(q, corpus, k, exclude_self=exclude_self), corpus, name)


def ivf_feed(arriving: DataFrame, index: _ivf.IVF, k: int, n_probes: int, name: str) -> DataFrame:
    """All answers to a stream that ends, by an inverted file."""
    return _run(arriving, lambda q: _ivf.search(q, index, k, n_probes), index.postings, name)


def _run(arriving: DataFrame, answer: Callable[[DataFrame], DataFrame], any_: DataFrame, name: str) -> DataFrame:
    import uuid

    spark = any_.sparkSession
    place = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}/{name}"
    answer_stream(arriving, answer, f"{place}/answers", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/answers").drop("batch")
