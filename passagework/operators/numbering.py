"""Global running numbers, first occurrences, batches and shards, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.runtime import materialize


def running_number(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``name``: 0, 1, 2, ... in the given order.

    Rows are sorted by ranges, counted in each partition, and every partition starts where the ones
    before it end; only one number for each partition comes together in one place.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    starts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    joined = local.join(starts.select("_part", "_start", "_low"), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_row") - F.col("_low")).drop("_part", "_row", "_start", "_low")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the given order; aggregated before the shuffle."""
    other = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in other if c not in order]]])
    best = df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in other])


def batch_number(n: str, size: int):
    """Number of the batch of ``size`` rows that row ``n`` is in."""
    if size < 1:
        raise ValueError("size must be positive")
    return F.floor(F.col(n) / size).cast("bigint")


def shard_number(n: str, total: int, shards: int):
    """Even ranges: ceil(total / shards) rows for each shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return F.floor(F.col(n) / max(1, -(-total // shards))).cast("bigint")


def download(items: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Passages and judged queries of nested source items that carry an ``item`` number.

    Passages are stripped, the first of equal texts is kept in order of encounter, up to ``cap``;
    a query keeps the selected passages that are among them and is dropped if there are none.
    """
    from passagework.functions.text import strip

    flat = items.select("item", F.posexplode(F.arrays_zip("passages.passage_text", "passages.is_selected")).alias("pos", "p"))
    flat = flat.select("item", "pos", strip(F.col("p.passage_text")).alias("text"), F.col("p.is_selected").alias("selected")).where("text <> ''")
    once = running_number(keep_first(flat.select("text", "item", "pos"), ["text"], ["item", "pos"]), ["item", "pos"], "ordinal")
    if cap is not None:
        once = once.where(F.col("ordinal") < cap)
    passages = once.select("ordinal", F.concat(F.lit("passage_"), "ordinal").alias("id"), "text")
    chosen = flat.where("selected = 1").join(passages.select("text"), "text", "left_semi")
    judged = chosen.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("j"))
    kept = items.select("item", "query", F.coalesce("query_type", F.lit("")).alias("query_type")).join(judged, "item")
    queries = running_number(kept, ["item"], "ordinal")
    return passages, queries.select("ordinal", F.concat(F.lit("query_"), "ordinal").alias("id"), F.col("query").alias("text"), "query_type", F.transform("j", lambda x: x["text"]).alias("relevant_passages"))
