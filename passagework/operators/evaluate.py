"""Retrieval quality (recall, reciprocal rank) and latency summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Variant:
    """How hits are judged.

    ``cut``: recall looks at the first k hits only; ``mrr_cut``: so does the reciprocal rank;
    ``drop_unjudged``: queries without judgments are left out instead of scoring 0.
    """

    cut: bool = True
    mrr_cut: bool = True
    drop_unjudged: bool = False


#: The four ways in which hits are judged; V3 is the usual one.
VARIANTS = {"V1": Variant(False, False), "V2": Variant(True, False), "V3": Variant(True, True), "V4": Variant(False, False, True)}


def judge(hits: DataFrame, judgments: DataFrame, run: list[str], k: int = 10, variant: str = "V3") -> DataFrame:
    """``*run, recall, rr`` for each run, from ``hits`` (*run, rank, text) and ``judgments`` (first of run, text).

    Judgments are counted once per text; recall counts distinct texts, the reciprocal rank takes
    the first judged hit.  A run without judgments scores 0 unless the variant drops it.
    """
    v = VARIANTS[variant]
    query = run[0]
    truth = judgments.select(query, "text").where("text is not null").distinct()
    wanted = truth.groupBy(query).agg(F.count(F.lit(1)).alias("wanted"))
    marked = hits.join(truth.withColumn("relevant", F.lit(True)), [query, "text"], "left")
    near = F.col("rank") <= k
    recall_hit = F.col("relevant") & (near if v.cut else F.lit(True))
    rank_hit = F.col("relevant") & (near if v.mrr_cut else F.lit(True))
    each = marked.groupBy(*run).agg(F.count_distinct(F.when(recall_hit, F.col("text"))).alias("hit"), F.min(F.when(rank_hit, F.col("rank"))).alias("first"))
    each = each.join(wanted, query, "left")
    if v.drop_unjudged:
        each = each.where("wanted is not null")
    zero = F.lit(0.0)
    return each.select(*run, F.round(F.coalesce(F.col("hit") / F.col("wanted"), zero), 6).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), zero), 6).alias("rr"))


def latency_columns(x: Column) -> list[Column]:
    """Mean, population deviation, median, exact 95th percentile, least and count."""
    d = x.cast("double")
    return [
        F.round(F.avg(d), 6).alias("mean_ms"), F.round(F.stddev_pop(d), 6).alias("std_ms"), F.round(F.median(d), 6).alias("median_ms"), F.round(F.percentile(d, F.lit(0.95)), 6).alias("p95_ms"),
        F.round(F.min(d), 6).alias("min_ms"), F.count(d).alias("n"),
    ]


def latency_summary(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Latency summary of each group; null and NaN values are left out."""
    return df.withColumn("_v", F.when(~F.isnan(value.cast("double")), value)).where("_v is not null").groupBy(*by).agg(*latency_columns(F.col("_v")))


def source_texts(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """``chunk_id, text``: the text of the passage a chunk came from, else the chunk's own."""
    once = chunks.groupBy("id").agg(F.min(F.struct("text", "source_id")).alias("c")).select("id", "c.text", "c.source_id")
    p = passages.select(F.col("id").alias("source_id"), F.col("text").alias("passage_text"))
    return once.join(p, "source_id", "left").select(F.col("id").alias("chunk_id"), F.coalesce("passage_text", "text").alias("text"))


def judged_queries(queries: DataFrame, most: int | None = None, order: str = "id") -> DataFrame:
    """Queries with at least one judgment; with ``most``, the first ones in the given order."""
    kept = queries.where(F.size("relevant_passages") > 0)
    return kept if most is None else kept.orderBy(order).limit(most)


def comparison_line(metric: Column, before: Column, after: Column) -> Column:
    """A line of text that shows a metric before and after, with two decimals, halves rounded up."""
    two = lambda x: F.format_string("%.2f", F.floor(F.round(x, 6) * 100 + 0.5) / 100)
    word = F.when(after > before, " (more)").when(after < before, " (less)").otherwise(" (same)")
    return F.concat(metric, F.lit(": "), two(before), F.lit(" -> "), two(after), word)


def improvement(baseline: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """``key, before, after, ratio``: how many times less the other takes; infinite where it takes nothing."""
    x, y = baseline.select(key, F.col(value).alias("before")), other.select(key, F.col(value).alias("after"))
    ratio = F.when(F.col("after") > 0, F.col("before") / F.col("after")).otherwise(F.lit(float("inf")))
    return x.join(y, key).select(key, "before", "after", ratio.alias("ratio"))
