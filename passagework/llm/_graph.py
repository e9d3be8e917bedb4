"""Groups from keys and from links, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.runtime import materialize

#: Into so many parts the rows of one key are split before they are joined.
SALTS = 32


def first_of_key(keys: DataFrame, key: list[str], node: str, salts: int = SALTS) -> DataFrame:
    """Columns of ``keys`` with ``first`` (lowest node) and ``copies`` (rows) of each key.

    Only keys with two rows or more are returned.  A key is counted in ``salts`` parts and the
    totals are handed back to the parts, so that a key that holds a third of all rows is never in
    one task; nothing is broadcast.
    """
    salted = keys.withColumn("_salt", F.pmod(F.xxhash64(F.col(node)), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*key, "_salt").agg(F.min(node).alias("_low"), F.count(F.lit(1)).alias("_n"))
    whole = (
        parts.groupBy(*key)
        .agg(F.min("_low").alias("first"), F.sum("_n").alias("copies"), F.collect_set("_salt").alias("_salts"))
        .where("copies > 1")
        .withColumn("_salt", F.explode("_salts"))
        .drop("_salts")
    )
    return salted.join(whole, [*key, "_salt"]).drop("_salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (lowest node of its group) for every node that has a link.

    Minimum labels are propagated along the links and shortened by pointer jumping until nothing
    changes.  Links of a node to itself and repeated links do no harm; no links give no rows.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialize(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    state = materialize(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("root")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = state.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        step = materialize(step, "step")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(step.join(up, "root").select("node", "was", F.least("root", "up").alias("root")), "labels")
        changed = new.where("root <> was").limit(1).count()
        state = new.select("node", "root")
        if not changed:
            return state
