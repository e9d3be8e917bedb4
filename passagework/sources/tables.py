"""JSON lines, NPY vectors, knowledge bases, reports and file checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import schema
from passagework.runtime import ship


def read_jsonl(spark: SparkSession, path: str, like: T.StructType) -> DataFrame:
    """JSON lines of a known schema; a broken line is an error."""
    return spark.read.schema(like).option("mode", "FAILFAST").json(path)


def stream_jsonl(spark: SparkSession, path: str, like: T.StructType, files: int = 1) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.schema(like).option("mode", "FAILFAST").option("maxFilesPerTrigger", files).json(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``file, vec_id, embedding`` of two-dimensional NPY files of numbers, rows numbered through all files in order of their names.

    Only headers are read at first; then every task reads ranges of ``NPY_ROWS`` rows by their offset,
    so a file may be of any size.
    """
    ship(spark)
    names = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # one row for each file
    ranges, before = [], 0
    for name in names:
        rows, width, kind, start = _npy_header(name)
        step = np.dtype(kind).itemsize * width
        ranges += [(name, before + i, start + i * step, min(NPY_ROWS, rows - i), width, kind) for i in range(0, rows, NPY_ROWS)]
        before += rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _opened(r["file"]) as source:
                    source.seek(r["at"])
                    x = np.frombuffer(source.read(r["rows"] * r["width"] * np.dtype(r["kind"]).itemsize), r["kind"]).astype(np.float32)
                n, width = r["rows"], r["width"]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * n), pa.array(np.arange(r["first"], r["first"] + n)), lists], ["file", "vec_id", "embedding"])

    table = spark.createDataFrame(ranges, "file string, first long, at long, rows int, width int, kind string")
    return table.repartition(max(1, min(len(ranges), 4096))).mapInArrow(run, "file string, vec_id long, embedding array<float>")


#: Rows of an NPY file that are read at once.
NPY_ROWS = 1 << 14


def _opened(name: str):
    """A file of any file system that Arrow knows, with random access."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", name))
    return system.open_input_file(path)


def _npy_header(name: str) -> tuple[int, int, str, int]:
    """(rows, columns, type, where the numbers begin); other than two dimensions in C order is an error."""
    import io

    with _opened(name) as source:
        head = io.BytesIO(source.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 2 or fortran or kind.hasobject:
        raise ValueError(f"{name} is no two-dimensional array of numbers in C order")
    return shape[0], shape[1], kind.str, head.tell()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha256, size_bytes`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """``file, status`` of every file of a manifest: "ok", "changed" or "missing"."""
    from passagework.operators.experiments import verify_hashes

    return verify_hashes(expected, manifest(spark, path), "file", "sha256")


@dataclass
class KnowledgeBase:
    """Passages, chunks, vectors and queries of one data set."""

    name: str
    passages: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    queries: DataFrame


def load_knowledge_base(spark: SparkSession, folder: str, name: str = "default") -> KnowledgeBase:
    """Reads the four tables; a folder without them is an error that names it."""
    try:
        tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("passages", "chunks", "vectors", "queries")]
    except Exception as x:
        raise FileNotFoundError(f"no knowledge base in {folder}: build it first") from x
    return KnowledgeBase(name, *tables)


def save_results(results: DataFrame, path: str) -> None:
    """Measurements by data set; those of the data sets in ``results`` replace what was there."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def save_experiment(results: DataFrame, path: str) -> None:
    """Measurements of steps, added to what is there."""
    results.write.mode("append").partitionBy("dataset", "step").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON file of a small report."""
    df.coalesce(1).write.mode("overwrite").json(path)


SCHEMAS = {"passages": schema.PASSAGE, "queries": schema.QUERY, "chunks": schema.CHUNK, "source_items": schema.SOURCE_ITEM}

#: Sizes of data sets by name, as (passages, queries).
PRESETS = {"small": (5_000, 100), "medium": (100_000, 500), "large": (500_000, 1_000)}


def sizes(preset: str = "medium", passages: int | None = None, queries: int | None = None) -> tuple[int, int]:
    """Passages and queries of a preset, where they are not given."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    p, q = PRESETS[preset]
    return passages or p, queries or q


def build_counts(passages: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``passages, chunks, vectors, paired, complete``: different ids of each, and how many chunks have a vector."""
    c, v = chunks.select(F.col("id").alias("chunk_id")).where("chunk_id is not null").distinct(), vectors.select("chunk_id").where("chunk_id is not null").distinct()
    both = c.withColumn("c", F.lit(1)).join(v.withColumn("v", F.lit(1)), "chunk_id", "full_outer")
    out = both.agg(F.count("c").alias("chunks"), F.count("v").alias("vectors"), F.count(F.col("c") + F.col("v")).alias("paired"))
    whole = passages.agg(F.count(F.lit(1)).alias("passages"))
    out = whole.withColumn("_k", F.lit(1)).join(out.withColumn("_k", F.lit(1)), "_k")
    return out.select("passages", "chunks", "vectors", "paired", ((F.col("chunks") == F.col("paired")) & (F.col("vectors") == F.col("paired"))).alias("complete"))


#: What a knowledge base consists of.
REQUIRED = ("passages.parquet", "chunks.parquet", "vectors.parquet", "queries.parquet")


def presence(spark: SparkSession, folder: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``file, present, size``: which of the required files or folders are there, and how large they are; contents are not read."""
    from passagework.functions.text import human_size

    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    except AnalysisException:  # no such folder
        found = spark.createDataFrame([], "path string, length long")
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_extract("path", f"/{re.escape(root)}/([^/]+)", 1)
    sizes = found.groupBy(name.alias("file")).agg(F.sum("length").alias("bytes"))
    wanted = spark.createDataFrame([(r,) for r in required], "file string")
    out = wanted.join(sizes, "file", "left")
    return out.select("file", F.col("bytes").isNotNull().alias("present"), human_size(F.coalesce("bytes", F.lit(0))).alias("size"))


def write_build_report(stages: DataFrame, folder: str, path: str) -> DataFrame:
    """One row of a build: seconds of each stage, their sum, and digest and size of every file below ``folder``."""
    files = manifest(stages.sparkSession, folder)
    times = stages.agg(F.map_from_entries(F.collect_list(F.struct("stage", "seconds"))).alias("seconds"), F.sum("seconds").alias("total_seconds"))
    listed = files.agg(F.sort_array(F.collect_list(F.struct("file", "sha256", "size_bytes"))).alias("files"))
    report = times.withColumn("_k", F.lit(1)).join(listed.withColumn("_k", F.lit(1)), "_k").drop("_k")
    write_report(report, path)
    return report


def check_knowledge_base(kb: KnowledgeBase) -> DataFrame:
    """``what, chunks, vectors, ok``: whether each chunk has a vector and each vector a chunk."""
    c, v = kb.chunks.select(F.col("id").alias("chunk_id")).distinct(), kb.vectors.select("chunk_id").where("chunk_id is not null").distinct()
    both = c.withColumn("c", F.lit(1)).join(v.withColumn("v", F.lit(1)), "chunk_id", "full_outer")
    out = both.agg(F.count("c").alias("chunks"), F.count("v").alias("vectors"), F.coalesce(F.bool_and(F.col("c").isNotNull() & F.col("v").isNotNull()), F.lit(True)).alias("ok"))
    return out.select(F.lit("a vector for each chunk").alias("what"), "chunks", "vectors", "ok")
