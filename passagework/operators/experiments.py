"""Bookkeeping of measurements: speedups, best configurations, comparisons, flattening, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics of which less is better.
LESS_IS_BETTER = ("mean_ms", "std_ms", "p95_ms", "total_ms", "median_ms", "latency_ms", "build_ms", "ttft_ms")


def canonical_variant(variant: Column) -> Column:
    """One spelling of a variant: lower case, without white space."""
    return F.lower(F.regexp_replace(variant, r"[\s\p{Z}]+", ""))


def clean_metrics(results: DataFrame) -> DataFrame:
    """Rows delivered twice once, one spelling of variants, no null or NaN values."""
    once = results.dropDuplicates(["run_no"])
    return once.where(F.col("metric_value").isNotNull() & ~F.isnan("metric_value")).withColumn("variant", canonical_variant(F.col("variant")))


def speedup(values: DataFrame, key: list[str], baseline: Column, value: str) -> DataFrame:
    """``speedup`` of every row against the baseline row of its ``key``; null where that is missing or zero."""
    base = values.where(baseline).groupBy(*key).agg(F.min(value).alias("_base")) if key else values.where(baseline).agg(F.min(value).alias("_base"))
    joined = values.join(base, key, "left") if key else values.join(base.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), "left").drop("_one")
    return joined.withColumn("speedup", F.round(F.when(F.col(value) != 0, F.col("_base") / F.col(value)), 6)).drop("_base")


def best(values: DataFrame, key: list[str], name: str, value: str, higher: Column) -> DataFrame:
    """Best ``name`` of each key by the value, the larger or the smaller one; ties go to the lower name."""
    good = F.when(higher, -F.col(value)).otherwise(F.col(value))
    return values.groupBy(*key).agg(F.min_by(F.struct(F.col(name), F.col(value)), F.struct(good, F.col(name))).alias("_b")).select(*key, F.col(f"_b.{name}").alias(f"best_{name}"), F.col(f"_b.{value}").alias(f"best_{value}"))


def compare(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """``*key, a, b, delta, pct, arrow``: full outer join of two sets of measurements; no delta beside a null."""
    x, y = a.select(*key, F.col(value).alias("a")), b.select(*key, F.col(value).alias("b"))
    both = x.join(y, key, "full_outer")
    delta = F.col("b") - F.col("a")
    return both.select(
        *key, F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(delta, 6).alias("delta"), F.round(F.when(F.col("a") != 0, delta / F.abs("a") * 100), 4).alias("pct"),
        F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same").alias("arrow"),
    )


def progression(values: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Value before and change since then, along the steps of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(value).over(w)
    return values.withColumn("before", before).withColumn("change", F.round(F.col(value) - before, 6))


def flatten_json(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """``*key, name, value`` of every top-level field of a JSON object; broken JSON gives no rows."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.select(*key, F.explode(parsed).alias("name", "value"))


def pivot_metrics(values: DataFrame, key: list[str], metrics: list[str], value: str) -> DataFrame:
    """One column for each named metric, the mean where there are several values."""
    return values.groupBy(*key).agg(*[F.round(F.avg(F.when(F.col("metric") == m, F.col(value))), 6).alias(m) for m in metrics])


def verify_hashes(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, status`` ("ok", "changed", "missing") of every expected digest."""
    x, y = expected.select(key, F.col(digest).alias("_x")), actual.select(key, F.col(digest).alias("_y"))
    status = F.when(F.col("_y").isNull(), "missing").when(F.col("_x") == F.col("_y"), "ok").otherwise("changed")
    return x.join(y, key, "left").select(key, status.alias("status"))


def config_grid(configs: DataFrame, modes: DataFrame) -> DataFrame:
    """Every configuration with every mode; both are small lists that someone wrote by hand."""
    return configs.withColumn("_k", F.lit(1)).join(modes.withColumn("_k", F.lit(1)), "_k").drop("_k")


def updated(a: Column, b: Column) -> Column:
    """Map ``a`` updated with ``b``: what both have is taken from ``b``; a null map counts as an empty one."""
    empty = F.create_map().cast("map<string,double>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)


def without_metadata(df: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose named columns begins with an underscore; null names are left out."""
    for c in columns:
        df = df.where(~F.startswith(F.col(c), F.lit("_")))
    return df


def lookup(plan: DataFrame, grid: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``plan`` with what the grid holds for their key; what it does not hold is left out."""
    return plan.join(grid, key)


def stage_totals(values: DataFrame, key: list[str], stages: dict[str, str], queries: int) -> DataFrame:
    """``*key, total_ms, complete``: so many queries one after the other through all stages (name to section); a missing stage counts as 0."""
    sums = values.groupBy(*key).agg(*[F.sum(F.when(F.col("section") == section, F.col("value"))).alias(name) for name, section in stages.items()])
    total = sum((F.coalesce(n, F.lit(0.0)) for n in stages), F.lit(0.0)) * queries
    complete = F.lit(True)
    for n in stages:
        complete = complete & F.col(n).isNotNull()
    return sums.select(*key, F.round(total, 4).alias("total_ms"), complete.alias("complete"))


def max_abs_diff(a: DataFrame, b: DataFrame, key: list[str], value: str, digits: int = 6) -> DataFrame:
    """Largest difference of two kernels' results, and how many rows they share."""
    joined = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key)
    return joined.agg(F.round(F.max(F.abs(F.col("_a") - F.col("_b"))), digits).alias("max_abs_diff"), F.count(F.lit(1)).alias("n"))
