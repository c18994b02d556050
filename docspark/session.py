"""Session settings, the shared scratch folder and tables written there."""

from __future__ import annotations

import hashlib
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


# How written tables and intermediate results are kept; they are read a few times, and their size is most of the disk that a query takes.
WRITTEN = {"compression": "zstd"}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, laptops) may fall back to a folder of its own: on a cluster a machine-local
    folder would be lost with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="docspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder that belongs to this application; the application's folder goes when it ends."""
    own = "/".join([checkpoint_dir(spark).rstrip("/"), spark.sparkContext.applicationId])
    if spark.conf.get("spark.docspark.scratch", None) != own:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        spark.conf.set("spark.docspark.scratch", own)
    return "/".join([own, *parts])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialize(spark: SparkSession, name: str, key: str, build) -> DataFrame:
    """Write ``build()`` once per application as parquet, then read it back.

    The written table cuts the lineage and survives lost executors; later readers get column pruning and
    filter pushdown on it.
    """
    digest = hashlib.sha256(key.encode()).hexdigest()[:12]
    path = scratch_path(spark, f"{name}-{digest}")
    if not path_exists(spark, path + "/_SUCCESS"):
        rows = build()
        with shuffles_freed(spark):
            rows.write.mode("overwrite").options(**WRITTEN).parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly when the scan has fewer splits than the cluster has cores.

    A large table brings many splits of its own and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (what ``--py-files`` does), once per application."""
    if spark.conf.get("spark.docspark.shipped", None):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docspark-")
    archive = shutil.make_archive(f"{folder}/docspark", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.docspark.shipped", archive)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes inside leave no shuffle files: these go when a write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read, and go on from the written table."""
    path = scratch_path(df.sparkSession, f"step-{uuid.uuid4().hex}")
    with shuffles_freed(df.sparkSession):
        df.write.options(**WRITTEN).parquet(path)
    return settled(df.sparkSession, path, df.schema)


def settled(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An intermediate result as it was written at ``path``."""
    out = spark.read.schema(schema).parquet(path)
    out.step = path
    return out


def discard(*results: DataFrame) -> None:
    """Delete the files of settled results that nothing is going to read."""
    for df in results:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(df.step)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
