"""Reports on measurements, experiments and data sets: queries of the catalogue with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions import text
from passagework.operators import evaluate, experiments
from passagework.plans import catalog
from passagework.plans.catalog import _LESS, _METRICS, metrics, query, sql_stripped, table

_MEAN = _METRICS + ", a AS (SELECT dataset, step, section, metric, variant, avg(metric_value) AS value FROM m GROUP BY ALL)"


def means(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return metrics(spark, d).groupBy(*by).agg(F.avg("metric_value").alias("value"))


@query("SELECT dataset, step, strftime(saved_at, '%Y-%m-%dT%H:%M:%S') AS saved_iso, strftime(saved_at, '%Y%m%d_%H%M%S') AS stamp FROM experiments")
def saved_at_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "experiments")
    return e.select("dataset", "step", text.iso_time(F.col("saved_at")).alias("saved_iso"), text.time_stamp(F.col("saved_at")).alias("stamp"))


@query(_METRICS + ", x AS (SELECT dataset, metric, avg(CASE WHEN step = 'step_0_baseline' THEN metric_value END) AS a, avg(CASE WHEN step = 'step_5_threads' THEN metric_value END) AS b FROM m GROUP BY ALL) SELECT dataset, metric AS name, round(coalesce(b, a), 6) AS value FROM x WHERE a IS NOT NULL OR b IS NOT NULL")
def merged_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the first step updated with those of a later one."""
    m = means(spark, d, "dataset", "step", "metric")

    def maps(step: str, name: str) -> DataFrame:
        return m.where(F.col("step") == step).groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias(name))

    both = maps("step_0_baseline", "a").join(maps("step_5_threads", "b"), "dataset", "full_outer")
    return both.select("dataset", F.explode(experiments.updated(F.col("a"), F.col("b"))).alias("name", "value")).select("dataset", "name", F.round("value", 6).alias("value"))


@query("SELECT DISTINCT section || '.' || metric AS name FROM results_bag WHERE NOT starts_with(metric, '_') AND NOT starts_with(section, '_')")
def public_metric_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of metrics, without those of metadata, which begin with an underscore."""
    names = experiments.without_metadata(table(spark, d, "results_bag"), "section", "metric")
    return names.select(F.concat_ws(".", "section", "metric").alias("name")).distinct()


@query(_MEAN + f" SELECT dataset, metric, variant, round(value, 6) AS value FROM (SELECT dataset, metric, variant, avg(value) AS value FROM a WHERE starts_with(variant, 'ivf') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dataset, metric ORDER BY CASE WHEN {_LESS} THEN value ELSE -value END, variant) = 1")
def best_of_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The best variant among those whose name begins with ``ivf``."""
    v = means(spark, d, "dataset", "step", "section", "metric", "variant").where(F.startswith("variant", F.lit("ivf"))).groupBy("dataset", "metric", "variant").agg(F.avg("value").alias("value"))
    best = experiments.best(v, ["dataset", "metric"], "variant", "value", ~F.col("metric").isin(*experiments.LESS_IS_BETTER))
    return best.select("dataset", "metric", F.col("best_variant").alias("variant"), F.round("best_value", 6).alias("value"))


@query("SELECT step, coalesce(description, '') AS description, row_number() OVER (ORDER BY step) AS place FROM experiments WHERE dataset = 'medium'")
def experiments_of_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Experiments of one data set in the order of their names."""
    e = table(spark, d, "experiments").where("dataset = 'medium'")
    return e.select("step", F.coalesce("description", F.lit("")).alias("description"), F.row_number().over(Window.partitionBy("dataset").orderBy("step")).alias("place"))


@query(_METRICS + " SELECT dataset, step, section, count(*) AS measurements, round(avg(metric_value), 6) AS mean FROM m WHERE section = 'similarity' GROUP BY ALL")
def results_of_section(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of one section, as results of one device are looked at."""
    m = metrics(spark, d).where("section = 'similarity'")
    return m.groupBy("dataset", "step", "section").agg(F.count(F.lit(1)).alias("measurements"), F.round(F.avg("metric_value"), 6).alias("mean"))


_PLAN = [("baseline", "bruteforce", "mean_ms"), ("index", "ivf(64,8)", "mean_ms"), ("wide index", "ivf(256,8)", "mean_ms"), ("quality", "ivf(64,8)", "recall"), ("unknown", "lsh", "mean_ms")]


@query("WITH plan AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in _PLAN) + ") t(config, variant, metric)), " + _MEAN[5:] + " SELECT config, dataset, a.variant, a.metric, round(avg(value), 6) AS value FROM plan JOIN a USING (variant, metric) GROUP BY ALL")
def planned_configs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a plan looked up in the grid of measurements; what was not measured is left out."""
    plan = spark.createDataFrame(_PLAN, "config string, variant string, metric string")
    found = experiments.lookup(plan, means(spark, d, "dataset", "step", "section", "metric", "variant"), ["variant", "metric"])
    return found.groupBy("config", "dataset", "variant", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


@query(_MEAN + ", t AS (SELECT dataset, step, variant, sum(CASE WHEN section = 'embedding' THEN value END) AS embed, sum(CASE WHEN section = 'index' THEN value END) AS search, sum(CASE WHEN section = 'generation' THEN value END) AS generation FROM a WHERE metric = 'mean_ms' GROUP BY ALL) SELECT dataset, step, variant, round(8 * (coalesce(embed, 0) + coalesce(search, 0) + coalesce(generation, 0)), 4) AS total_ms, embed IS NOT NULL AND search IS NOT NULL AND generation IS NOT NULL AS complete FROM t")
def what_if_totals(spark: SparkSession, d: str) -> DataFrame:
    """What eight queries would take in each configuration, one stage after the other."""
    a = means(spark, d, "dataset", "step", "section", "metric", "variant").where("metric = 'mean_ms'")
    return experiments.stage_totals(a, ["dataset", "step", "variant"], {"embed": "embedding", "search": "index", "generation": "generation"}, 8)


@query(_MEAN + ", b AS (SELECT dataset, metric, avg(value) AS before FROM a WHERE variant = 'bruteforce' GROUP BY ALL), o AS (SELECT dataset, metric, variant, avg(value) AS after FROM a WHERE variant <> 'bruteforce' GROUP BY ALL) SELECT dataset, variant, metric, metric || ': ' || printf('%.2f', floor(round(before, 6) * 100 + 0.5) / 100) || ' -> ' || printf('%.2f', floor(round(after, 6) * 100 + 0.5) / 100) || CASE WHEN after > before THEN ' (more)' WHEN after < before THEN ' (less)' ELSE ' (same)' END AS line FROM b JOIN o USING (dataset, metric)")
def comparison_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line of text for every metric of each variant beside the baseline."""
    a = means(spark, d, "dataset", "step", "section", "metric", "variant")
    base = a.where("variant = 'bruteforce'").groupBy("dataset", "metric").agg(F.avg("value").alias("before"))
    other = a.where("variant <> 'bruteforce'").groupBy("dataset", "metric", "variant").agg(F.avg("value").alias("after"))
    return base.join(other, ["dataset", "metric"]).select("dataset", "variant", "metric", evaluate.comparison_line(F.col("metric"), F.col("before"), F.col("after")).alias("line"))


@query(_MEAN + f", v AS (SELECT dataset, section, metric, variant, avg(value) AS value FROM a GROUP BY ALL) SELECT dataset, section, metric, count(*) AS variants, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, arg_min(variant, CASE WHEN {_LESS} THEN value ELSE -value END) AS best FROM v GROUP BY dataset, section, metric")
def summary_report(spark: SparkSession, d: str) -> DataFrame:
    """Range and best variant of every metric of each section."""
    v = means(spark, d, "dataset", "step", "section", "metric", "variant").groupBy("dataset", "section", "metric", "variant").agg(F.avg("value").alias("value"))
    good = F.when(F.col("metric").isin(*experiments.LESS_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    return v.groupBy("dataset", "section", "metric").agg(F.count(F.lit(1)).alias("variants"), F.round(F.min("value"), 6).alias("lowest"), F.round(F.max("value"), 6).alias("highest"), F.min_by("variant", good).alias("best"))


@query(f"WITH t AS (SELECT {sql_stripped('text')} AS text FROM passages), c AS (SELECT count(*) AS scanned, count(CASE WHEN text <> '' THEN 1 END) AS filled, count(DISTINCT CASE WHEN text <> '' THEN text END) AS different FROM t) SELECT scanned, filled, different, least(different, 500) AS kept FROM c")
def intake_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many items were scanned, held text, differed, and would be kept under a cap of 500."""
    t = table(spark, d, "passages").select(text.strip(F.col("text")).alias("text"))
    filled = F.when(F.col("text") != "", F.col("text"))
    c = t.agg(F.count(F.lit(1)).alias("scanned"), F.count(filled).alias("filled"), F.count_distinct(filled).alias("different"))
    return c.withColumn("kept", F.least("different", F.lit(500).cast("bigint")))


@query("WITH c AS (SELECT count(DISTINCT id) AS n FROM chunks), v AS (SELECT count(DISTINCT chunk_id) AS n FROM vectors), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT id FROM chunks) JOIN (SELECT DISTINCT chunk_id FROM vectors) ON id = chunk_id), p AS (SELECT count(*) AS n FROM passages) SELECT p.n AS passages, c.n AS chunks, v.n AS vectors, b.n AS paired, c.n = b.n AND v.n = b.n AS complete FROM p, c, v, b")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of a knowledge base and whether each chunk has a vector and each vector a chunk."""
    from passagework.sources import tables

    return tables.build_counts(table(spark, d, "passages"), table(spark, d, "chunks"), table(spark, d, "vectors"))
