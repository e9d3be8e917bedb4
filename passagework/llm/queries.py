"""Queries of this subpackage over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import abuse_scores, density_clusters, encoding_repair, format_duplicates, genetic_packing, prefix_forest, soft_mixing, sparse_product, text_pieces
from passagework.runtime import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that are copies of one with a lower ordinal, but for formatting."""
    found = format_duplicates.format_duplicates(_table(spark, sf_dir, "passages"))
    return found.select(F.col("first").alias("first_ordinal"), F.col("node").alias("ordinal"))


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage per set of copies, with the number of copies."""
    return format_duplicates.copy_counts(_table(spark, sf_dir, "passages")).select(F.col("first").alias("first_ordinal"), "copies")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of sets of similar embeddings with the lowest vec_id of their set."""
    sets, _ = density_clusters.density_sets(_table(spark, sf_dir, "vectors"))
    return sets.where("node <> root").select(F.col("root").alias("first_vec_id"), F.col("node").alias("vec_id"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of similar embeddings with their sizes and most typical members."""
    return density_clusters.cluster_report(_table(spark, sf_dir, "vectors"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embeddings of which one is among the five nearest of the other."""
    near = prefix_forest.neighbours(_table(spark, sf_dir, "vectors"))
    return near.select(F.least("a", "b").alias("lo_vec_id"), F.greatest("a", "b").alias("hi_vec_id")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest embeddings, with cosines, of every embedding whose vec_id is divisible by 50."""
    near = prefix_forest.neighbours(_table(spark, sf_dir, "vectors"), queries="node % 50 = 0", exact=True)
    return near.select(F.col("a").alias("vec_id"), "place", F.col("b").alias("near_vec_id"), "cosine")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [_table(spark, sf_dir, t).select(F.lit(t).alias("origin"), "id", "text") for t in ("passages", "queries")]
    return both[0].union(both[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of passages and queries that were decoded with the wrong encoding."""
    return encoding_repair.garbled(_texts(spark, sf_dir)).select("origin", "id")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the original text, null where it can't be told."""
    return encoding_repair.garbled(_texts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in a group of near-duplicates with the lowest ordinal of their group."""
    groups = sparse_product.near_duplicates(_table(spark, sf_dir, "passages"), n=3, t=0.5)
    return groups.where("node <> root").select(F.col("root").alias("first_ordinal"), F.col("node").alias("ordinal"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of passages over 256 words."""
    return text_pieces.oversized(_table(spark, sf_dir, "passages"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the passages over 256 words."""
    return text_pieces.text_pieces(_table(spark, sf_dir, "passages"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and position of every document, or its pieces, for each capacity."""
    return genetic_packing.pack(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pack_sizes"))


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for each mix, with their number of uses."""
    return soft_mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source of each mix."""
    targets = _table(spark, sf_dir, "mix_targets")
    drawn = materialize(soft_mixing.mix(_table(spark, sf_dir, "documents"), targets), "drawn")
    return soft_mixing.shares(_table(spark, sf_dir, "documents"), targets, drawn)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    scores = abuse_scores.abuse_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "abuse_labels"))
    return scores.where(F.col("score") >= abuse_scores.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score."""
    scores = abuse_scores.abuse_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "abuse_labels"))
    return scores.select("doc_id", F.round("score", 4).alias("score"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents of every source."""
    return abuse_scores.abuse_rates(abuse_scores.abuse_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "abuse_labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {
        "p1_found": p1_found,
        "p1_copies": p1_copies,
        "p2_found": p2_found,
        "p2_clusters": p2_clusters,
        "p3_found": p3_found,
        "p3_neighbours": p3_neighbours,
        "p4_found": p4_found,
        "p4_restored": p4_restored,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p7_packed": p7_packed,
        "p8_drawn": p8_drawn,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_scores": p9_scores,
        "p9_rates": p9_rates,
    }


_PASSAGE_KEYS = r"""
WITH parts AS (
  SELECT ordinal, text, list_filter(regexp_split_to_array(text, '[;|\n\r\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]'), lambda p: regexp_matches(p, '[^\s\x{1c}-\x{1f}\x{85}\p{Z}]')) AS p
  FROM passages WHERE text IS NOT NULL
), typed AS (
  SELECT ordinal, text, p, len(p) >= 3 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]*[^\s\x{1c}-\x{1f}\x{85}\p{Z}:=][^:=]*[:=].*[^\s\x{1c}-\x{1f}\x{85}\p{Z}]'))) = 0 AS record FROM parts
), keys AS (
  SELECT ordinal, record, CASE WHEN record
    THEN array_to_string(list_sort(list_filter(list_transform(p, lambda x: regexp_replace(replace(replace(lower(x), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '')), '/')
    ELSE regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}]', '', 'g') END AS k FROM typed
), sets AS (
  SELECT ordinal, min(ordinal) OVER (PARTITION BY record, replace(k, 'µ', 'μ')) AS first_ordinal, k FROM keys WHERE k <> ''
)
"""

_UNIT = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM vectors
  WHERE embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
)
"""

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables.

    The searches of p3 are approximate (recall is tested against brute force), p2 and p5 need
    groups; where SQL over all pairs is still quick at the size it is run on, it is given.
    """
    return {
        "p1_found": _PASSAGE_KEYS + "SELECT DISTINCT first_ordinal, ordinal FROM sets WHERE ordinal <> first_ordinal",
        "p1_copies": _PASSAGE_KEYS + "SELECT first_ordinal, count(*) AS copies FROM sets GROUP BY first_ordinal HAVING count(*) > 1",
        "p6_found": rf"SELECT DISTINCT id AS source_id FROM passages WHERE len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')) > 256",
    }
