"""Session helpers: shared materialisation, package shipping and size-checked joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset (tests on one
    machine) a temporary folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    local = os.path.join(tempfile.gettempdir(), f"passagework-{os.getpid()}")
    os.makedirs(local, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{local}")
    return f"file://{local}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner a true file size, so
    that a join against a small result is broadcast only when it really is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/passagework-{uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").parquet(path)
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has already ended
            return


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="passagework-")) / "passagework.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
