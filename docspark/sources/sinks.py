"""Writers for chunks, logs, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docspark import schemas
from docspark.sources.snapshots import SnapshotTable

CSV = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_chunks(chunks: DataFrame, path: str) -> None:
    """All chunk columns as JSON lines, one folder per document type."""
    chunks.write.mode("overwrite").partitionBy("doc_type").json(path)


def write_chunk_metadata(chunks: DataFrame, path: str) -> None:
    """The chunk columns without the text, as CSV."""
    write_csv(chunks.drop("text"), path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**CSV).csv(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def replace_audit(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def recreate_index(chunks: DataFrame, path: str) -> None:
    """Replace the whole chunk table. Readers see the old or the new one whole, also after a stop in between."""
    SnapshotTable(chunks.sparkSession, path, schemas.CHUNKS).replace(chunks)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest in path order; the range sort keeps the write parallel."""
    manifest.orderBy("path").write.mode("overwrite").parquet(path)


def write_text(documents: DataFrame, column: str, path: str) -> None:
    """One text value per document."""
    documents.select(column).write.mode("overwrite").option("lineSep", "\u0000").text(path)
