"""Readers for page caches, metadata CSVs, audit logs and the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark import schemas
from docspark.sources.sinks import CSV
from docspark.sources.snapshots import SnapshotTable


def load_pages_json(spark: SparkSession, path: str, default_name: str = "", one_per_file: bool = True) -> DataFrame:
    """Page caches ``{source_file, pages: [{page_num, text}]}`` as document rows with a pages array; one JSON text per file, or per line."""
    docs = spark.read.schema(schemas.PAGE_CACHE).option("multiLine", one_per_file).json(path)
    return docs.select(F.coalesce("source_file", F.lit(default_name)).alias("source_file"), "pages")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV written by this package; quoted values may hold line breaks."""
    return spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path)


def load_metadata_csvs(spark: SparkSession, path: str) -> DataFrame:
    """All metadata CSVs under a path; unreadable files are skipped and blank dates are null."""
    spark_reader = spark.read.schema(schemas.CHUNK_METADATA).options(**CSV).option("multiLine", True)
    return spark_reader.option("ignoreCorruptFiles", True).csv(path)


def load_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit log lines, blank and malformed ones dropped, with their date."""
    rows = spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("timestamp").isNotNull()).withColumn("date", F.to_date("timestamp"))


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of the chunk table; an index that is not there yet reads as empty."""
    return SnapshotTable(spark, path, schemas.CHUNKS).read()


def index_sample_excluding(chunks: DataFrame, source_file: str, n: int = 5) -> DataFrame:
    """The first ``n`` chunks of other files, for a spot check after a partial rebuild."""
    return chunks.filter(F.col("source_file") != source_file).orderBy("chunk_id").limit(n)
