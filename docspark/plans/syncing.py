"""Registered queries: sources, sinks and synchronisation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions.names import nfc
from docspark.functions.pages import raw_dump
from docspark.operators import search_index
from docspark.operators import sync as Y
from docspark.operators.search_index import SearchIndex
from docspark.plans import derived as D
from docspark.plans.oracle.base import WS, q, with_chunks, with_corpus
from docspark.plans.registry import query
from docspark.plans.reports import TOXIC_FILES, toxic_files
from docspark.plans.structure import RAW_PAGES, raw_documents
from docspark.session import settle, spread
from docspark.sources import files, sinks, tables
from docspark.sources.snapshots import SnapshotTable

CHUNK_SQL = "SELECT chunk_id, doc_name, doc_type, article_no, article_title, page, source_file, md5(text) AS text_md5 FROM "


def _narrow(chunks):
    return chunks.select(
        "chunk_id", "doc_name", "doc_type", "article_no", "article_title", F.col("page").cast("bigint").alias("page"), "source_file",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


# --- sources and sinks -------------------------------------------------------------------------------------
_LISTING = f"""listing AS (SELECT page_id, '/data/' || CASE WHEN page_id % 5 = 0 THEN {q(P.EXCLUDED_FOLDERS[0])} || '/' ELSE '' END || page_id || '/'
 || regexp_replace(url, '^[a-z]+://', '') || ['.pdf', '.HWP', '.hwpx', '.txt'][page_id % 4 + 1] AS path, strlen(html) AS length FROM pages)"""


def page_files(spark, sf):
    """The web pages as files: two roots, of which the second repeats every third file."""
    i = F.col("page_id")
    folder = F.when(i % 5 == 0, P.EXCLUDED_FOLDERS[0] + "/").otherwise("")
    ending = F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".HWP", ".hwpx", ".txt"))), (i % 4 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), folder, i.cast("string"), F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""), ending)
    files = D.table(spark, sf, "pages").select(
        i, path.alias("path"), F.timestamp_seconds(i).alias("modificationTime"), F.octet_length("html").cast("bigint").alias("length"), F.encode("html", "UTF-8").alias("content")
    )
    first = files.withColumn("root_no", F.lit(0))
    return first.unionByName(files.filter(i % 3 == 0).withColumn("root_no", F.lit(1)))


@query("scan_files", f"""WITH {_LISTING} SELECT path, lower(split_part(path, '.', -1)) AS suffix, length AS size_bytes, 0 AS root_no, page_id::DOUBLE AS mtime FROM listing
 WHERE page_id % 5 <> 0 AND page_id % 4 <> 3 AND length >= {P.MIN_FILE_SIZE}""")
def scan_files(spark, sf):
    return files.indexable(page_files(spark, sf)).select("path", "suffix", "size_bytes", "root_no", "mtime")


@query("hash_files", f"WITH {_LISTING} SELECT path, length AS size_bytes, sha256(html) AS sha256 FROM listing JOIN pages USING (page_id)")
def hash_files(spark, sf):
    """The web pages written as files, and all of them touched; beside each lies a file that is not."""
    folder = D.fresh(spark, "page-files")
    at = re.sub("^file:/+", "/", folder)
    named = F.regexp_replace("path", "/([^/]*)$", "/f-$1")  # names that start with a dot are not listed
    pages = spread(page_files(spark, sf).filter("root_no = 0").select(named.alias("path"), "content"))
    touched = settle(pages.mapInArrow(D.write_files(folder), "path string").select(F.concat(F.lit(at), "path").alias("path")))
    path = F.regexp_replace(F.substring("path", len(at) + 1, 1 << 20), "/f-([^/]*)$", "/$1")
    return files.hash_files(spark, [folder], touched).select(path.alias("path"), "size_bytes", "sha256")


@query("hash_documents", "SELECT doc_id, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents")
def hash_documents(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


_PAGES_SQL = "SELECT source_file, p + 1 AS page_num, md5(substr(text, p * 3000 + 1, 3000)) AS text_md5 FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 2999) // 3000))) AS p FROM corpus)"


@query("load_pages_json", with_corpus(" " + _PAGES_SQL.replace("SELECT source_file,", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'unnamed' ELSE source_file END AS source_file,", 1)))
def load_pages_json(spark, sf):
    """Every tenth cache has no file name."""
    path = D.scratch(spark, "page-cache", sf)
    D.corpus(spark, sf).select(F.when(F.col("doc_id") % 10 != 0, F.col("source_file")).alias("source_file"), "pages").write.mode("overwrite").json(path)
    rows = tables.load_pages_json(spark, path, "unnamed", one_per_file=False).select("source_file", F.explode("pages").alias("p"))
    return rows.select("source_file", F.col("p.page_num").cast("bigint").alias("page_num"), F.md5(F.col("p.text").cast("binary")).alias("text_md5"))


@query("write_chunks", with_chunks(" " + CHUNK_SQL + "chunks"))
def write_chunks(spark, sf):
    path = D.scratch(spark, "chunks-json", sf)
    sinks.write_chunks(D.chunks(spark, sf), path)
    return _narrow(spark.read.schema(D.chunks(spark, sf).schema).json(path))


_META = "SELECT chunk_id, doc_name, doc_type, nullif(article_no, '') AS article_no, nullif(article_title, '') AS article_title, page, is_current, source_file FROM chunks"


def _metadata(spark, sf):
    path = D.scratch(spark, "chunks-csv", sf)
    sinks.write_chunk_metadata(D.chunks(spark, sf), path)
    rows = tables.load_metadata_csvs(spark, path)
    text = [F.nullif(c, F.lit("")).alias(c) for c in ("article_no", "article_title")]
    return rows.select("chunk_id", "doc_name", "doc_type", *text, F.col("page").cast("bigint").alias("page"), "is_current", "source_file")


@query("write_chunk_metadata", with_chunks(" " + _META))
def write_chunk_metadata(spark, sf):
    return _metadata(spark, sf)


@query("load_metadata_csvs", with_chunks(" SELECT doc_name, doc_type, count(*) AS n_rows FROM chunks GROUP BY 1, 2"))
def load_metadata_csvs(spark, sf):
    return _metadata(spark, sf).groupBy("doc_name", "doc_type").agg(F.count("*").alias("n_rows"))


@query("recreate_index", with_chunks(" " + CHUNK_SQL + "chunks"))
def recreate_index(spark, sf):
    path = D.scratch(spark, "index", sf)
    sinks.recreate_index(D.chunks(spark, sf), path)
    return _narrow(tables.scan_index(spark, path))


@query("scan_index", with_chunks(" SELECT source_file, count(*) AS n_chunks FROM chunks GROUP BY 1"))
def scan_index(spark, sf):
    path = D.scratch(spark, "index-scan", sf)
    empty = tables.scan_index(spark, path + "-absent")
    sinks.recreate_index(D.chunks(spark, sf), path)
    rows = tables.scan_index(spark, path).unionByName(empty)
    return rows.groupBy("source_file").agg(F.count("*").alias("n_chunks"))


@query("index_sample_excluding", with_chunks(" SELECT chunk_id, article_no, source_file FROM chunks WHERE source_file <> '혁신법 시행령 src1_1.pdf' ORDER BY chunk_id LIMIT 5"))
def index_sample_excluding(spark, sf):
    return tables.index_sample_excluding(D.chunks(spark, sf), "혁신법 시행령 src1_1.pdf", 5).select("chunk_id", "article_no", "source_file")


@query("write_raw_dump", with_corpus(
    " SELECT md5(string_agg('=== PAGE ' || page_num || ' ===' || chr(10) || text || chr(10) || chr(10), '' ORDER BY page_num)) AS dump_md5 FROM raw_pages GROUP BY doc_id", RAW_PAGES))
def write_raw_dump(spark, sf):
    path = D.scratch(spark, "raw-dump", sf)
    sinks.write_text(raw_documents(spark, sf).select(raw_dump(F.col("pages")).alias("dump")), "dump", path)
    rows = spark.read.option("lineSep", "\u0000").text(path)
    return rows.select(F.md5(F.col("value").cast("binary")).alias("dump_md5"))


# --- upsert and delete -------------------------------------------------------------------------------------
@query("upsert_chunks", """SELECT doc_id::VARCHAR AS chunk_id, md5(CASE WHEN v.vec_id IS NULL THEN text ELSE upper(lang) || text END) AS text_md5 FROM documents LEFT JOIN embeddings v ON doc_id = vec_id""")
def upsert_chunks(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "lang", "text")
    incoming = d.select("chunk_id", F.concat(F.upper("lang"), "text").alias("text"))
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"))
    table = SnapshotTable(spark, D.fresh(spark, "upserted"), "chunk_id string, text string", "chunk_id")
    table.replace(d.select("chunk_id", "text"))
    Y.upsert_table(table, incoming, vectors)
    return table.read().select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("upsert_skipped", "SELECT doc_id::VARCHAR AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def upsert_skipped(spark, sf):
    """Incoming rows without a vector."""
    incoming = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return Y.without_vector(incoming, D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id")))


@query("delete_chunks", with_chunks(f" SELECT chunk_id, source_file FROM chunks WHERE source_file NOT IN (SELECT source_file FROM toxic_files)", TOXIC_FILES))
def delete_chunks(spark, sf):
    return Y.delete_chunks(D.chunks(spark, sf), toxic_files(spark, sf)).select("chunk_id", "source_file")


# --- listing and manifest ----------------------------------------------------------------------------------
LISTING = """
listing AS (SELECT doc_id, '/corpus/' || source_file AS path, source_file, doc_type, 1700000000.0::DOUBLE + doc_id AS mtime, length(text) AS size_bytes, sha256(text) AS sha256, text FROM corpus)
"""
MANIFEST = f"""
manifest AS (
 SELECT path, mtime + CASE WHEN size_bytes % 2 = 0 THEN 0 ELSE 5 END AS mtime, CASE WHEN quality = 0 THEN sha256(sha256) ELSE sha256 END AS sha256, size_bytes,
  CASE WHEN toxic = 1 THEN '{P.LEGACY_VERSION}' ELSE '{P.CHUNKER_VERSION}' END AS chunker_version, '{P.EMBEDDER_VERSION}' AS embedder_version, doc_type <> 'FAQ' AS indexed, false AS missing_on_disk, doc_type
 FROM listing JOIN labels USING (doc_id)
 UNION ALL
 SELECT CASE WHEN contains(url, 'page=') THEN url ELSE '/web/' || page_id END, 0.0, '', 0, '{P.LEGACY_VERSION}', '{P.EMBEDDER_VERSION}', true, contains(url, '#top'), '' FROM pages
)
"""
CHANGES = f"""
changes AS (SELECT * FROM (SELECT coalesce(l.path, m.path) AS path, l.source_file, l.text, l.doc_type, CASE
  WHEN l.path IS NULL THEN CASE WHEN m.indexed AND NOT m.missing_on_disk AND starts_with(m.path, '/') THEN 'deleted' END
  WHEN m.path IS NULL THEN 'added' WHEN NOT m.indexed THEN 'skipped'
  WHEN (abs(l.mtime - m.mtime) > 0.001 OR l.size_bytes <> m.size_bytes) AND l.sha256 <> m.sha256 THEN 'modified'
  WHEN m.chunker_version <> '{P.CHUNKER_VERSION}' OR m.embedder_version <> '{P.EMBEDDER_VERSION}' THEN 'stale_code' ELSE 'unchanged' END AS change
 FROM listing l FULL JOIN manifest m ON l.path = m.path) WHERE change IS NOT NULL)
"""


def listing(spark, sf):
    docs = D.corpus(spark, sf).withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), ""))
    return docs.select(
        "doc_id", F.concat(F.lit("/corpus/"), "source_file").alias("path"), "source_file", "doc_type",
        (F.lit(1.7e9) + F.col("doc_id")).alias("mtime"), F.length("text").cast("bigint").alias("size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.size("pages").cast("bigint").alias("page_count"),
    )


def manifest(spark, sf):
    known = listing(spark, sf).join(D.table(spark, sf, "labels"), "doc_id")
    old = F.when(F.col("toxic") == 1, P.LEGACY_VERSION).otherwise(P.CHUNKER_VERSION)
    rows = known.select(
        "path", (F.col("mtime") + F.when(F.col("size_bytes") % 2 == 0, 0).otherwise(5)).alias("mtime"),
        F.when(F.col("quality") == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), "size_bytes",
        old.alias("chunker_version"), F.lit(P.EMBEDDER_VERSION).alias("embedder_version"), F.lit(0).cast("bigint").alias("n_chunks"), "doc_type",
        "page_count", (F.col("doc_type") != "FAQ").alias("indexed"), F.lit(None).cast("string").alias("skip_reason"), F.lit(False).alias("missing_on_disk"),
    )
    web = D.table(spark, sf, "pages")
    path = F.when(F.contains("url", F.lit("page=")), F.col("url")).otherwise(F.concat(F.lit("/web/"), F.col("page_id").cast("string")))
    gone = web.select(
        path.alias("path"), F.lit(0.0).alias("mtime"), F.lit("").alias("sha256"), F.lit(0).cast("bigint").alias("size_bytes"),
        F.lit(P.LEGACY_VERSION).alias("chunker_version"), F.lit(P.EMBEDDER_VERSION).alias("embedder_version"), F.lit(0).cast("bigint").alias("n_chunks"),
        F.lit("").alias("doc_type"), F.lit(0).cast("bigint").alias("page_count"), F.lit(True).alias("indexed"), F.lit(None).cast("string").alias("skip_reason"),
        F.contains("url", F.lit("#top")).alias("missing_on_disk"),
    )
    return rows.unionByName(gone)


def changes(spark, sf):
    on_disk, known = listing(spark, sf), manifest(spark, sf)
    stats = on_disk.select("path", "mtime", "size_bytes")
    hashes = on_disk.select("path", "sha256").join(Y.touched(stats, known), "path", "left_semi")
    return Y.classify(stats, known, hashes)


@query("sync_classify", with_corpus(" SELECT path, change FROM changes", LISTING, MANIFEST, CHANGES))
def sync_classify(spark, sf):
    return changes(spark, sf)


_CLASS_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS change, count(*) FILTER (WHERE change = '{c}') AS n_files FROM changes" for c in Y.CLASSES)


@query("change_summary", with_corpus(" " + _CLASS_ROWS, LISTING, MANIFEST, CHANGES))
def change_summary(spark, sf):
    return Y.change_summary(changes(spark, sf))


@query("reindex_set", with_corpus(" SELECT path FROM changes WHERE change IN ('added', 'modified', 'stale_code')", LISTING, MANIFEST, CHANGES))
def reindex_set(spark, sf):
    return Y.reindex_set(changes(spark, sf))


STATUS = f"""
status AS (SELECT path, source_file, doc_type, CASE WHEN length(trim(text, {WS})) = 0 THEN 'parse_empty' WHEN n IS NULL THEN 'chunk_empty' ELSE 'ok' END AS status, coalesce(n, 0) AS n_chunks,
  greatest(1, (length(text) + 2999) // 3000) AS page_count
 FROM listing LEFT JOIN (SELECT source_file, count(*) AS n FROM chunks GROUP BY 1) USING (source_file))
"""


def status(spark, sf):
    docs = D.corpus(spark, sf).withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), ""))
    pages = docs.select("source_file", F.size("pages").cast("bigint").alias("page_count"), F.length(F.btrim("text", F.lit(P.WHITESPACE))).alias("text_len"))
    rows = Y.ingest_status(docs.select("source_file", "doc_type"), pages, D.chunks(spark, sf))
    return rows.withColumn("path", F.concat(F.lit("/corpus/"), "source_file"))


@query("ingest_files", with_chunks(" SELECT source_file, status, doc_type, page_count, n_chunks FROM status", LISTING, STATUS))
def ingest_files(spark, sf):
    """The corpus chunked, embedded and indexed, with one status row per file."""
    return search_index.ingest(SearchIndex(spark, D.fresh(spark, "ingested-index")), D.corpus(spark, sf))


@query("apply_summary", with_chunks(""" SELECT count(*) FILTER (WHERE change IN ('added', 'modified', 'stale_code') AND status = 'ok') AS indexed, count(*) FILTER (WHERE change = 'deleted') AS deleted,
 count(*) FILTER (WHERE change IN ('added', 'modified', 'stale_code') AND status IN ('parse_empty', 'chunk_empty')) AS skipped,
 count(*) FILTER (WHERE change IN ('added', 'modified', 'stale_code') AND status IS NULL) AS errors FROM changes LEFT JOIN (SELECT path, status FROM status) USING (path)""", LISTING, MANIFEST, CHANGES, STATUS))
def apply_summary(spark, sf):
    return Y.apply_summary(changes(spark, sf), status(spark, sf))


_APPLIED = """ SELECT m.path, m.chunker_version, m.indexed, NULL::VARCHAR AS skip_reason, 0::BIGINT AS n_chunks FROM manifest m LEFT JOIN changes c ON m.path = c.path WHERE c.change IS NULL OR c.change IN ('unchanged', 'skipped')
 UNION ALL SELECT c.path, '{v}', status = 'ok', CASE WHEN status <> 'ok' THEN status END, CASE WHEN status = 'ok' THEN n_chunks ELSE 0 END FROM changes c JOIN status s ON c.path = s.path WHERE change IN ('added', 'modified', 'stale_code')"""


@query("sync_apply", with_chunks(_APPLIED.replace("{v}", P.CHUNKER_VERSION), LISTING, MANIFEST, CHANGES, STATUS))
def sync_apply(spark, sf):
    on_disk = listing(spark, sf)
    out = Y.apply_manifest(
        changes(spark, sf), manifest(spark, sf), on_disk.select("path", "mtime", "size_bytes"), on_disk.select("path", "sha256"),
        status(spark, sf).select("path", "status", "n_chunks", "doc_type", "page_count"),
    )
    return out.select("path", "chunker_version", "indexed", "skip_reason", "n_chunks")


@query("sync_apply_chunks", with_chunks(""" SELECT path, md5(text) AS text_md5 FROM (
 SELECT path, text FROM listing JOIN labels USING (doc_id) LEFT JOIN (SELECT path, change FROM changes) c USING (path) WHERE change IS NULL OR change IN ('unchanged', 'skipped')
 UNION ALL SELECT path, c.text FROM chunks c JOIN (SELECT source_file, path FROM changes WHERE change IN ('added', 'modified', 'stale_code')) USING (source_file))""", LISTING, MANIFEST, CHANGES))
def sync_apply_chunks(spark, sf):
    docs = D.corpus(spark, sf).withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), ""))
    old = docs.join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(F.concat(F.lit("/corpus/"), "source_file").alias("path"), "text")
    new = D.chunks(spark, sf).select(F.concat(F.lit("/corpus/"), "source_file").alias("path"), "text")
    table = SnapshotTable(spark, D.fresh(spark, "applied"), "path string, text string", "path")
    table.replace(old)
    Y.apply_to_table(table, changes(spark, sf), new, status(spark, sf))
    return table.read().select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("write_manifest", with_corpus(" SELECT path, chunker_version, indexed, missing_on_disk FROM manifest", LISTING, MANIFEST))
def write_manifest(spark, sf):
    path = D.scratch(spark, "manifest", sf)
    sinks.write_manifest(manifest(spark, sf), path)
    return spark.read.parquet(path).select("path", "chunker_version", "indexed", "missing_on_disk")


@query("version_staleness", with_corpus(f" SELECT chunker_version, count(*) AS n_files, chunker_version <> '{P.CHUNKER_VERSION}' AS stale FROM manifest WHERE indexed GROUP BY 1", LISTING, MANIFEST))
def version_staleness(spark, sf):
    from docspark.operators.quality import version_staleness as report

    return report(manifest(spark, sf))


_PREFIXED = " OR ".join(f"starts_with(source_file, {q(p)})" for p in P.CURRENT_NAME_PREFIXES)


@query("init_manifest", with_chunks(f""" SELECT coalesce(path, source_file) AS path, coalesce(sha256, '') AS sha256, CASE WHEN {_PREFIXED} THEN '{P.CHUNKER_VERSION}' ELSE '{P.LEGACY_VERSION}' END AS chunker_version, n_chunks, dt AS doc_type,
 CASE WHEN path IS NULL THEN 0 ELSE pc END AS page_count, path IS NOT NULL AS indexed, path IS NULL AS missing_on_disk
 FROM (SELECT source_file, count(*) AS n_chunks, max(page) AS pc, arg_min(doc_type, chunk_id) AS dt FROM chunks GROUP BY 1)
 LEFT JOIN (SELECT source_file, path, sha256 FROM listing JOIN labels USING (doc_id)) USING (source_file)""", LISTING))
def init_manifest(spark, sf):
    there = listing(spark, sf).join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    out = Y.init_manifest(D.chunks(spark, sf), there.select("source_file", "path", "mtime", "size_bytes", "sha256"))
    return out.select("path", "sha256", "chunker_version", "n_chunks", "doc_type", "page_count", "indexed", "missing_on_disk")


@query("resolve_source_path", with_corpus(""" SELECT source_file, path FROM (
 SELECT source_file, CASE WHEN b IS NULL THEN '/a/x/' || source_file ELSE '/b/' || source_file END AS path FROM corpus LEFT JOIN (SELECT doc_id, true AS b FROM labels) USING (doc_id)
 UNION ALL SELECT '/a/x/' || source_file, '/a/x/' || source_file FROM corpus UNION ALL SELECT url || '.pdf', NULL FROM pages)"""))
def resolve_source_path(spark, sf):
    """Two roots: the labelled files lie in both, the others in the second one only; web names lie in neither."""
    names = D.corpus(spark, sf).select("doc_id", "source_file")
    labelled = names.join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    second = names.select(F.concat(F.lit("/a/x/"), "source_file").alias("path"), F.lit(1).alias("root_no"))
    first = labelled.select(F.concat(F.lit("/b/"), "source_file").alias("path"), F.lit(0).alias("root_no"))
    asked = names.select("source_file").unionByName(second.select(F.col("path").alias("source_file"))).unionByName(
        D.table(spark, sf, "pages").select(F.concat("url", F.lit(".pdf")).alias("source_file"))
    )
    return Y.resolve_source_path(asked, first.unionByName(second), nfc)


@query("ingest_checkpoint", with_corpus(" SELECT path, doc_id NOT IN (SELECT doc_id FROM labels) AS was_pending FROM listing", LISTING))
def ingest_checkpoint(spark, sf):
    todo = listing(spark, sf).select("doc_id", "path")
    done = todo.join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    waiting = Y.pending(todo.select("path"), done)
    log = Y.mark_done(done, waiting)
    return log.join(waiting.withColumn("was_pending", F.lit(True)), "path", "left").na.fill(False, ["was_pending"])
