"""Incremental synchronisation: listing against manifest, and applying the changes.

The manifest holds one row per file with the number of its chunks; the chunks of a file are found by ``source_file`` in the
chunk table, so no list of ids has to be gathered per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.sources.snapshots import SnapshotTable

CLASSES = ("added", "modified", "deleted", "stale_code", "unchanged", "skipped")
REINDEXED = ("added", "modified", "stale_code")
MTIME_TOLERANCE = 1e-3


def touched(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths whose time or size differs from the manifest: the only ones whose content has to be hashed."""
    return listing.join(manifest.select("path", F.col("mtime").alias("m"), F.col("size_bytes").alias("s"), "indexed"), "path").filter(
        F.col("indexed") & ((F.abs(F.col("mtime") - F.col("m")) > MTIME_TOLERANCE) | (F.col("size_bytes") != F.col("s")))
    ).select("path")


def classify(listing: DataFrame, manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """path and change class of every file in the listing (path, mtime, size_bytes) or the manifest.

    ``hashes`` (path, sha256) is needed for the touched paths only. Manifest rows that are gone from disk count as
    deleted when they were indexed under an absolute path; other absent rows are left out.
    """
    disk = listing.select("path", F.struct("mtime", "size_bytes").alias("d"))
    known = manifest.select("path", F.struct(*[c for c in manifest.columns if c != "path"]).alias("m"))
    rows = disk.join(known, "path", "full_outer").join(hashes.select("path", F.col("sha256").alias("sha")), "path", "left")
    moved = (F.abs(F.col("d.mtime") - F.col("m.mtime")) > MTIME_TOLERANCE) | (F.col("d.size_bytes") != F.col("m.size_bytes"))
    indexed = F.coalesce("m.indexed", F.lit(True))
    gone = indexed & ~F.coalesce("m.missing_on_disk", F.lit(False)) & F.startswith("path", F.lit("/"))
    stale = ~F.col("m.chunker_version").eqNullSafe(F.lit(P.CHUNKER_VERSION)) | ~F.col("m.embedder_version").eqNullSafe(
        F.lit(P.EMBEDDER_VERSION)
    )
    kind = (
        F.when(F.col("d").isNull(), F.when(gone, "deleted"))
        .when(F.col("m").isNull(), "added").when(~indexed, "skipped")
        .when(moved & ~F.col("sha").eqNullSafe(F.col("m.sha256")), "modified").when(stale, "stale_code").otherwise("unchanged")
    )
    return rows.select("path", kind.alias("change")).filter(F.col("change").isNotNull())


def change_summary(changes: DataFrame) -> DataFrame:
    """Files per change class; every class is listed."""
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in CLASSES]
    return changes.agg(*counts).unpivot([], list(CLASSES), "change", "n_files")


def reindex_set(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change").isin(*REINDEXED)).select("path").distinct()


def _replaced(changes: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths whose chunks go, and paths whose new chunks come; ``status`` (path, status) is the outcome per file.

    The chunks of a file are replaced only when its new ones are there or it is known to be empty: a file that failed keeps what it had.
    """
    outcome = changes.join(status.select("path", "status"), "path", "left")
    again = F.col("change").isin(*REINDEXED)
    gone = outcome.filter((F.col("change") == "deleted") | (again & F.col("status").isin("ok", "parse_empty", "chunk_empty")))
    return gone.select("path"), outcome.filter(again & (F.col("status") == "ok")).select("path")


def apply_chunks(changes: DataFrame, old: DataFrame, new: DataFrame, status: DataFrame) -> DataFrame:
    """Chunk rows after the changes; ``old`` and ``new`` carry a path."""
    gone, fresh = _replaced(changes, status)
    kept = old.join(gone, "path", "left_anti")
    return kept.unionByName(new.join(fresh, "path", "left_semi").select(*old.columns))


def apply_to_table(table: SnapshotTable, changes: DataFrame, new: DataFrame, status: DataFrame) -> None:
    """The same in a chunk table whose key is the path, as one snapshot: only the buckets of changed files are read and written."""
    gone, fresh = _replaced(changes, status)
    table.upsert(new.join(fresh, "path", "left_semi"), gone)


def apply_manifest(changes: DataFrame, manifest: DataFrame, listing: DataFrame, hashes: DataFrame, status: DataFrame) -> DataFrame:
    """Manifest after the changes: deleted rows go, reindexed rows are rewritten, failed and unchanged rows stay."""
    again = changes.filter(F.col("change").isin(*REINDEXED)).join(
        status.filter(F.col("status").isin("ok", "parse_empty", "chunk_empty")), "path"
    )
    ok = F.col("status") == "ok"
    rewritten = again.join(listing, "path").join(hashes, "path", "left").select(
        "path", "mtime", "sha256", "size_bytes", F.lit(P.CHUNKER_VERSION).alias("chunker_version"),
        F.lit(P.EMBEDDER_VERSION).alias("embedder_version"), F.when(ok, F.col("n_chunks")).otherwise(F.lit(0)).alias("n_chunks"),
        "doc_type", "page_count", ok.alias("indexed"), F.when(~ok, F.col("status")).alias("skip_reason"),
        F.lit(False).alias("missing_on_disk"),
    )
    gone = changes.filter(F.col("change") == "deleted").select("path").unionByName(rewritten.select("path"))
    return manifest.join(gone, "path", "left_anti").unionByName(rewritten)


def apply_summary(changes: DataFrame, status: DataFrame) -> DataFrame:
    """Files indexed, deleted, skipped and failed."""
    rows = changes.join(status.select("path", "status"), "path", "left")
    again = F.col("change").isin(*REINDEXED)

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return rows.agg(
        n(again & (F.col("status") == "ok")).alias("indexed"), n(F.col("change") == "deleted").alias("deleted"),
        n(again & F.col("status").isin("parse_empty", "chunk_empty")).alias("skipped"),
        n(again & (F.col("status").isNull() | (F.col("status") == "error"))).alias("errors"),
    )


def delete_chunks(chunks: DataFrame, gone: DataFrame, key: str = "source_file") -> DataFrame:
    """Chunks whose key (chunk_id or source_file) is not among the given ones."""
    return chunks.join(gone.select(key), key, "left_anti")


def upsert(index: DataFrame, incoming: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Incoming rows that have an embedding replace rows of the same id; ``without_vector`` lists the others."""
    embedded = incoming.join(embeddings.select(key), key, "left_semi")
    return index.join(embedded.select(key), key, "left_anti").unionByName(embedded.select(*index.columns))


def upsert_table(table: SnapshotTable, incoming: DataFrame, embeddings: DataFrame) -> None:
    """The same in a chunk table whose key is the chunk's id: only the buckets of the incoming rows are read and written."""
    table.upsert(incoming.join(embeddings.select(table.key), table.key, "left_semi"))


def without_vector(incoming: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The ids of incoming rows that an upsert leaves out, because they have no embedding."""
    return incoming.select(key).join(embeddings.select(key), key, "left_anti")


def initial_version(source_file: Column) -> Column:
    """Chunker version assumed for files indexed before a manifest was kept."""
    name = F.element_at(F.split(source_file, "/"), -1)
    current = F.lit(False)
    for prefix in P.CURRENT_NAME_PREFIXES:
        current = current | F.startswith(name, F.lit(prefix))
    return F.when(current, P.CHUNKER_VERSION).otherwise(P.LEGACY_VERSION)


def init_manifest(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest from an index: per source file its chunks, last page and type; files not on disk are not indexed.

    ``files``: source_file, path, mtime, size_bytes, sha256.
    """
    per_file = chunks.filter(F.col("source_file") != "").groupBy("source_file").agg(
        F.count("*").alias("n_chunks"), F.max("page").cast("bigint").alias("page_count"), F.min_by("doc_type", "chunk_id").alias("doc_type")
    )
    rows = per_file.join(files, "source_file", "left")
    found = F.col("path").isNotNull()
    return rows.select(
        F.coalesce("path", "source_file").alias("path"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"),
        F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        initial_version(F.col("source_file")).alias("chunker_version"), F.lit(P.EMBEDDER_VERSION).alias("embedder_version"),
        "n_chunks", "doc_type", F.when(found, F.col("page_count")).otherwise(F.lit(0)).alias("page_count"),
        found.alias("indexed"), F.lit(None).cast("string").alias("skip_reason"), (~found).alias("missing_on_disk"),
    )


def resolve_source_path(sources: DataFrame, files: DataFrame, nfc) -> DataFrame:
    """source_file to path: absolute paths that exist pass through, others match by NFC base name, first root first.

    ``files``: path, root_no. ``nfc`` runs on distinct names.
    """

    def base(path: str) -> Column:
        return F.element_at(F.split(path, "/"), -1)

    names = sources.select("source_file").filter(F.col("source_file") != "").distinct()
    names = names.withColumn("whole", nfc(F.col("source_file"))).withColumn("name", base("whole"))
    real = files.withColumn("name", nfc(base("path"))).filter(F.contains("name", F.lit(".")))
    best = real.groupBy("name").agg(F.min_by("path", F.struct("root_no", "path")).alias("found"))
    there = files.select(F.col("path").alias("whole"), F.lit(True).alias("exists")).distinct()
    rows = names.join(there, "whole", "left").join(best, "name", "left")
    absolute = F.startswith("whole", F.lit("/")) & F.coalesce("exists", F.lit(False))
    return rows.select("source_file", F.when(absolute, F.col("whole")).otherwise(F.col("found")).alias("path"))


def pending(files: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Files that are not in the done log; all of them when forced."""
    return files if force else files.join(done.select("path"), "path", "left_anti")


def mark_done(done: DataFrame, finished: DataFrame) -> DataFrame:
    """Done log with the finished files added once."""
    return done.select("path").unionByName(finished.select("path").join(done.select("path"), "path", "left_anti")).distinct()


def ingest_status(files: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One status row per file (source_file, doc_type): ok, parse_empty or chunk_empty, with its counts.

    ``pages``: source_file, page_count, text_len; ``chunks``: source_file.
    """
    counts = chunks.groupBy("source_file").agg(F.count("*").alias("n_chunks"))
    rows = files.join(pages, "source_file", "left").join(counts, "source_file", "left")
    status = (
        F.when(F.coalesce("text_len", F.lit(0)) == 0, "parse_empty").when(F.col("n_chunks").isNull(), "chunk_empty").otherwise("ok")
    )
    return rows.select(
        "source_file", status.alias("status"), "doc_type", F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
    )
