"""Registered queries: usage, library and corpus quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.operators import quality as Z
from docspark.operators import usage as U
from docspark.plans import derived as D
from docspark.plans.oracle import search as S
from docspark.plans.oracle.base import q, strip, with_chunks
from docspark.plans.registry import query
from docspark.plans.retrieval import smart_hits

# --- audit -------------------------------------------------------------------------------------------------
ANSWERED = """answered AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
AUDIT = """audit AS (SELECT event_id, date_trunc('second', ts) AS timestamp, date_trunc('second', ts - to_milliseconds(k * 1234)) AS started_at,
 date_trunc('second', ts) AS ended_at, round(k * 1.234::DOUBLE, 2) AS duration_sec, 'Question ' || k AS question, event_type AS verdict,
 CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE round(least(value, 100.0), 1) END AS confidence, k % 5 AS citations_count, k % 3 = 0 AS follow_up,
 user_id % 2 = 0 AS mcp_used, k % 7 = 0 AS web_used FROM answered)"""
LOG = ["one AS (SELECT 1)", ANSWERED, AUDIT]
AUDIT_COLUMNS = "timestamp, started_at, ended_at, duration_sec, question, verdict, confidence, citations_count, follow_up, mcp_used, web_used"


def answered(spark, sf):
    e = D.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    start = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - F.col("k") * 1234000)
    return e.select(
        "event_id", start.alias("started_at"), F.col("ts").cast("timestamp").alias("ended_at"),
        F.concat(F.lit("Question "), F.col("k").cast("string")).alias("question"), F.col("event_type").alias("verdict"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.least("value", F.lit(100.0))).alias("confidence"),
        (F.col("k") % 5).alias("citations_count"), (F.col("k") % 3 == 0).alias("follow_up"),
        (F.col("user_id") % 2 == 0).alias("mcp_used"), (F.col("k") % 7 == 0).alias("web_used"),
    )


def audit(spark, sf):
    return U.audit_events(answered(spark, sf))


@query("append_audit", S.stmt(f"SELECT {AUDIT_COLUMNS} FROM audit", *LOG))
def append_audit(spark, sf):
    from docspark.sources import sinks, tables

    path = D.scratch(spark, "audit-log", sf)
    late = F.coalesce(F.col("confidence"), F.lit(0)) >= 50
    sinks.replace_audit(audit(spark, sf).filter(~late), path)
    sinks.append_audit(audit(spark, sf).filter(late), path)
    return tables.load_audit(spark, path).drop("date")


@query("load_audit", S.stmt(f"SELECT {AUDIT_COLUMNS}, timestamp::DATE AS date FROM audit WHERE NOT contains(verdict, 'view')", *LOG))
def load_audit(spark, sf):
    """A log in which some lines are cut off and some are blank."""
    from docspark.sources import tables

    line = F.to_json(F.struct(*AUDIT_COLUMNS.split(", ")))
    broken = F.when(F.col("verdict") == "view", F.when(F.col("follow_up"), "").otherwise(F.left(line, F.length(line) - 1))).otherwise(line)
    path = D.scratch(spark, "audit-broken", sf)
    audit(spark, sf).select(broken.alias("value")).write.mode("overwrite").text(path)
    return tables.load_audit(spark, path)


@query("usage_kpis", S.stmt("""SELECT count(*) AS n_questions, count(*) FILTER (WHERE timestamp::DATE = DATE '2024-01-15') AS n_on_day,
 round(avg(mcp_used::INT) * 100, 0) AS mcp_pct, round(avg(follow_up::INT) * 100, 0) AS follow_up_pct FROM audit""", *LOG))
def usage_kpis(spark, sf):
    return U.usage_kpis(audit(spark, sf), F.lit("2024-01-15").cast("date"))


@query("daily_questions", S.stmt("SELECT timestamp::DATE AS date, count(*) AS n FROM audit GROUP BY 1", *LOG))
def daily_questions(spark, sf):
    return U.daily_questions(audit(spark, sf))


@query("verdict_distribution", S.stmt("SELECT verdict, count(*) AS n FROM audit GROUP BY 1", *LOG))
def verdict_distribution(spark, sf):
    return U.verdict_distribution(audit(spark, sf))


@query("confidence_histogram", S.stmt(" UNION ALL ".join(
    f"SELECT {i}::BIGINT AS bin_no, '{label}' AS bin, count(*) FILTER (WHERE confidence > {P.CONFIDENCE_BINS[i]} AND confidence <= {P.CONFIDENCE_BINS[i + 1]}) AS n FROM audit"
    for i, label in enumerate(P.CONFIDENCE_LABELS)), *LOG))
def confidence_histogram(spark, sf):
    return U.confidence_histogram(audit(spark, sf))


@query("audit_recent", S.stmt(f"SELECT {AUDIT_COLUMNS} FROM audit", *LOG))
def audit_recent(spark, sf):
    return U.audit_recent(audit(spark, sf))


_FILTERED = "regexp_matches(question, '(?i)QUESTION 1') AND verdict IN ('click', 'purchase')"


@query("audit_filter", S.stmt(f"SELECT {AUDIT_COLUMNS} FROM audit WHERE {_FILTERED}", *LOG))
def audit_filter(spark, sf):
    return U.name_filter(audit(spark, sf), "question", "QUESTION 1", "verdict", ["click", "purchase"])


@query("export_audit_csv", S.stmt(f"SELECT {AUDIT_COLUMNS} FROM audit WHERE {_FILTERED}", *LOG))
def export_audit_csv(spark, sf):
    from docspark.sources import sinks, tables

    path = D.scratch(spark, "audit-csv", sf)
    rows = U.name_filter(audit(spark, sf), "question", "QUESTION 1", "verdict", ["click", "purchase"])
    sinks.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


# --- library -----------------------------------------------------------------------------------------------
_LIBRARY = """SELECT doc_name, doc_type, count(*) AS n_chunks, max(page) AS n_pages, arg_min(effective_date, chunk_id) AS effective_date,
 arg_min(revised_date, chunk_id) AS revised_date, arg_min(is_current, chunk_id) AS is_current, arg_min(source_file, chunk_id) AS source_file FROM chunks GROUP BY 1, 2"""


@query("library_summary", with_chunks(" " + _LIBRARY))
def library_summary(spark, sf):
    return U.library_summary(D.chunks(spark, sf)).withColumn("n_pages", F.col("n_pages").cast("bigint"))


@query("library_filter", with_chunks(f" SELECT * FROM ({_LIBRARY}) WHERE regexp_matches(doc_name, '(?i)SRC1') AND doc_type IN ('시행령', 'FAQ')"))
def library_filter(spark, sf):
    rows = U.name_filter(D.chunks(spark, sf), "doc_name", "SRC1", "doc_type", ["시행령", "FAQ"])
    return U.library_summary(rows).withColumn("n_pages", F.col("n_pages").cast("bigint"))


# --- quality -----------------------------------------------------------------------------------------------
@query("article_coverage", with_chunks(""" SELECT count(*) AS n_chunks, count(DISTINCT article_no) AS n_labels, count(*) FILTER (WHERE contains(article_no, '(part ')) AS n_forced,
 round(avg(contains(article_no, '(part ')::INT), 6) AS forced_ratio, count(*) FILTER (WHERE contains(doc_name, '매뉴얼') AND starts_with(article_no, '별표')) AS n_appendix_in_manual FROM chunks"""))
def article_coverage(spark, sf):
    return Z.article_coverage(D.chunks(spark, sf))


@query("multi_doc_articles", with_chunks(""" , pairs AS (SELECT DISTINCT article_no, doc_name FROM chunks WHERE article_no <> '' AND NOT starts_with(article_no, '(part') AND NOT contains(article_no, 'FAQ'))
 SELECT article_no, doc_name, n_docs FROM pairs JOIN (SELECT article_no, count(*) AS n_docs FROM pairs GROUP BY 1) USING (article_no) WHERE n_docs > 1"""))
def multi_doc_articles(spark, sf):
    return Z.multi_doc_articles(D.chunks(spark, sf))


_SHARES = """SELECT doc_name, n_chunks, round(share, 4) AS share_pct, share >= 95 AS alarm FROM (SELECT doc_name, count(*) AS n_chunks, count(*) / (SELECT count(*) FROM chunks) * 100 AS share FROM chunks GROUP BY 1)
 ORDER BY n_chunks DESC, doc_name LIMIT 10"""


@query("doc_distribution", with_chunks(" " + _SHARES))
def doc_distribution(spark, sf):
    return Z.doc_distribution(D.chunks(spark, sf))


@query("top_docs", with_chunks(" SELECT doc_name, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, doc_name LIMIT 15"))
def top_docs(spark, sf):
    return Z.top_docs(D.chunks(spark, sf))


@query("topic_diversity", S.stmt("""SELECT question_id, sum(n)::BIGINT AS top_k, count(*) AS n_docs, string_agg(doc_name || '=' || n, ',' ORDER BY doc_name) AS doc_counts, arg_min(doc_name, slot) AS top1_doc,
 arg_min(article_no, slot) AS top1_article, arg_min(page, slot) AS top1_page
 FROM (SELECT question_id, s.doc_name, count(*) AS n, min(slot) AS slot, arg_min(article_no, slot) AS article_no, arg_min(page, slot) AS page FROM smart s JOIN chunks USING (chunk_id) GROUP BY 1, 2) GROUP BY 1""", *S.SMART))
def topic_diversity(spark, sf):
    hits = smart_hits(spark, sf).select("question_id", "slot", "chunk_id", F.col("doc_name").alias("document_name"))
    out = Z.topic_diversity(hits.join(D.chunks(spark, sf).select("chunk_id", "article_no", "page"), "chunk_id"))
    entries = F.transform(F.map_entries("doc_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("doc_counts", F.array_join(entries, ",")).withColumn("top1_page", F.col("top1_page").cast("bigint"))


_METRICS = """SELECT count(*) AS total, avg(length(text)) AS avg_len, max(length(text)) AS max_len, count(*) FILTER (WHERE article_no IN ('', '서문')) AS n_blank,
 avg((article_no IN ('', '서문'))::INT) AS blank_share, count(*) FILTER (WHERE starts_with(article_no, '별표 ') AND contains(lower(source_file), 'pdf')) AS n_appendix_in_pdf FROM """
_ROUNDED = "SELECT total, round(avg_len, 4) AS avg_len, max_len, n_blank, round(blank_share * 100, 4) AS blank_pct, n_appendix_in_pdf FROM "


_DOC_NAMES = "SELECT doc_name, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, doc_name LIMIT 15"
_DOC_TYPES = "SELECT doc_type, count(*) AS n FROM chunks GROUP BY 1"
_APPENDICES = "SELECT split_part(article_no, ' (part', 1) AS appendix, count(*) AS n FROM chunks WHERE starts_with(article_no, '별표 ') AND contains(lower(source_file), '.hwp') GROUP BY 1"
_COUNTED = " UNION ALL SELECT '{0}', {0}, n, NULL, NULL, NULL, NULL, NULL FROM ({1})"
_PARTS = "".join(_COUNTED.format(part, counts) for part, counts in (("doc_name", _DOC_NAMES), ("doc_type", _DOC_TYPES), ("appendix", _APPENDICES)))


@query("index_metrics", with_chunks(f" {_ROUNDED.replace('SELECT', "SELECT 'index' AS part, NULL::VARCHAR AS name,", 1)} ({_METRICS} chunks){_PARTS}"))
def index_metrics(spark, sf):
    return Z.index_metrics(D.chunks(spark, sf)).select(
        "part", "name", "total", F.round("avg_len", 4).alias("avg_len"), "max_len", "n_blank", F.round(F.col("blank_share") * 100, 4).alias("blank_pct"), "n_appendix_in_pdf"
    )


@query("index_doc_types", with_chunks(" SELECT doc_type, count(*) AS n FROM chunks GROUP BY 1"))
def index_doc_types(spark, sf):
    return Z.doc_types(D.chunks(spark, sf))


@query("appendix_counts", with_chunks(" SELECT split_part(article_no, ' (part', 1) AS appendix, count(*) AS n FROM chunks WHERE starts_with(article_no, '별표 ') AND contains(lower(source_file), '.hwp') GROUP BY 1"))
def appendix_counts(spark, sf):
    return Z.appendix_counts(D.chunks(spark, sf))


TOXIC_FILES = "toxic_files AS (SELECT source_file FROM corpus JOIN labels USING (doc_id) WHERE toxic = 1)"


def toxic_files(spark, sf):
    toxic = D.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return D.corpus(spark, sf).select("doc_id", "source_file").join(toxic, "doc_id").select("source_file")


_UNPIVOT = """UNPIVOT (SELECT total, round(avg_len, 0)::BIGINT AS avg_len, max_len, n_blank, n_appendix_in_pdf FROM ({})) ON COLUMNS(*) INTO NAME metric VALUE v"""


@query("metrics_diff", with_chunks(f""", {TOXIC_FILES}, kept AS (SELECT * FROM chunks WHERE source_file NOT IN (SELECT source_file FROM toxic_files)),
 b AS ({_UNPIVOT.format(_METRICS + 'kept')}), a AS ({_UNPIVOT.format(_METRICS + 'chunks')}) SELECT metric, b.v AS before, a.v AS after, a.v - b.v AS delta FROM b JOIN a USING (metric)"""))
def metrics_diff(spark, sf):
    chunks = D.chunks(spark, sf)
    kept = chunks.join(toxic_files(spark, sf), "source_file", "left_anti")
    return Z.metrics_diff(Z.index_totals(kept), Z.index_totals(chunks))


@query("chunk_profile", with_chunks(""", pr AS (SELECT *, split_part(article_no, ' (part', 1) AS parent FROM chunks),
 tp AS (SELECT doc_type, string_agg(parent || ':' || n, '|' ORDER BY r) AS top_parents FROM (SELECT doc_type, parent, count(*) AS n, row_number() OVER (PARTITION BY doc_type ORDER BY count(*) DESC, parent) AS r FROM pr GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1)
 SELECT doc_type, count(*) AS n_chunks, count(DISTINCT article_no) AS n_labels, count(DISTINCT parent) AS n_parents, count(*) FILTER (WHERE contains(article_no, '(part ')) AS n_forced,
 round(avg(contains(article_no, '(part ')::INT) * 100, 4) AS forced_pct, min(page) AS page_min, max(page) AS page_max, count(DISTINCT page) AS n_pages, count(*) FILTER (WHERE starts_with(article_no, 'p.')) AS n_page_labels,
 any_value(top_parents) AS top_parents FROM pr JOIN tp USING (doc_type) GROUP BY 1"""))
def chunk_profile(spark, sf):
    return Z.chunk_profile(D.chunks(spark, sf), "doc_type")


_APPENDIX = f"regexp_matches(source_file, {q(P.APPENDIX_FILE_PATTERN)})"
_NUMBER = f"regexp_extract(source_file, {q(P.APPENDIX_FILE_PATTERN)}, 1)"
_KWS = ", ".join(f"count(*) FILTER (WHERE contains(text, {q(k)})) AS kw{i}" for i, k in enumerate(P.REBUILD_KEYWORDS))


@query("keyword_hits", with_chunks(f""" SELECT *, n_labelled >= 5 AS pass_chunks, text_len >= 10000 AS pass_chars, kw0 >= 1 AND kw1 >= 1 AND kw2 >= 1 AND kw3 >= 1 AND kw4 >= 1 AS pass_keywords FROM (
 SELECT source_file, count(*) AS n_chunks, count(*) FILTER (WHERE starts_with(article_no, '별표 ' || {_NUMBER}) OR starts_with(article_no, '별표' || {_NUMBER})) AS n_labelled, sum(length(text))::BIGINT AS text_len, {_KWS}
 FROM chunks WHERE {_APPENDIX} GROUP BY 1)"""))
def keyword_hits(spark, sf):
    return Z.keyword_hits(D.chunks(spark, sf))


_PRESENT = " + ".join(f"max(contains(text, {q(k)})::BIGINT)" for k in P.COVERAGE_KEYWORDS)


@query("keyword_coverage", with_chunks(f" SELECT source_file, {_PRESENT} AS n_present, {_PRESENT} >= 6 AS pass FROM chunks GROUP BY 1"))
def keyword_coverage(spark, sf):
    return Z.keyword_coverage(D.chunks(spark, sf))


@query("label_format_check", with_chunks(f" SELECT source_file, bool_and(regexp_matches(article_no, {q(P.APPENDIX_LABEL)})) AS uniform, count(*) FILTER (WHERE NOT regexp_matches(article_no, {q(P.APPENDIX_LABEL)})) AS n_offenders FROM chunks WHERE {_APPENDIX} GROUP BY 1"))
def label_format_check(spark, sf):
    return Z.label_format_check(D.chunks(spark, sf))


_PARTNO = r"coalesce(try_cast(regexp_extract(article_no, '\(part (\d+)/\d+\)', 1) AS BIGINT), 0)"


@query("adjacent_keywords", with_chunks(f""" SELECT source_file, first_at, second_at, coalesce(abs(first_at - second_at) <= 1, false) AS adjacent FROM (
 SELECT source_file, min(pos) FILTER (WHERE contains(text, '연구활동비')) AS first_at, min(pos) FILTER (WHERE contains(text, '혁신법')) AS second_at
 FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {_PARTNO}, chunk_id) - 1 AS pos FROM chunks) GROUP BY 1)"""))
def adjacent_keywords(spark, sf):
    return Z.adjacent_keywords(D.chunks(spark, sf), "연구활동비", "혁신법")


def _targets(spark, sf):
    docs = D.corpus(spark, sf).select("source_file", F.array_join(F.transform("pages", lambda p: p["text"]), "").alias("t"))
    there = docs.select("source_file", F.lit(True).alias("found"), F.length("t").cast("bigint").alias("text_len"))
    web = D.table(spark, sf, "pages").select(F.col("url").alias("source_file"), F.lit(False).alias("found"), F.lit(0).cast("bigint").alias("text_len"))
    return there.unionByName(web)


@query("reindex_report", with_chunks(""" SELECT source_file, CASE WHEN NOT found THEN 'missing' WHEN text_len = 0 THEN 'parse_empty' WHEN n IS NULL THEN 'chunk_empty' ELSE 'ok' END AS status,
 coalesce(n, 0) AS chunk_count, coalesce(chars, CASE WHEN found THEN text_len ELSE 0 END) AS text_len_total
 FROM (SELECT source_file, true AS found, length(text) AS text_len FROM corpus UNION ALL SELECT url, false, 0 FROM pages)
 LEFT JOIN (SELECT source_file, count(*) AS n, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1) USING (source_file)"""))
def reindex_report(spark, sf):
    return Z.reindex_report(_targets(spark, sf), D.chunks(spark, sf))


@query("label_distribution", with_chunks(" SELECT source_file, article_no, count(*) AS n FROM chunks GROUP BY 1, 2"))
def label_distribution(spark, sf):
    return Z.label_distribution(D.chunks(spark, sf))


def page_lengths(spark, sf):
    rows = D.corpus(spark, sf).select("source_file", F.explode("pages").alias("p"))
    from docspark.functions.text import strip as stripped

    return rows.select("source_file", F.col("p.page_num").cast("bigint").alias("page_num"), F.length(stripped(F.col("p.text"))).cast("bigint").alias("n_chars"))


PAGE_LENGTHS = f"""page_lengths AS (SELECT source_file, p + 1 AS page_num, length({strip('substr(text, p * 3000 + 1, 3000)')}) AS n_chars
 FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 2999) // 3000))) AS p FROM corpus)),
gaps AS (SELECT * FROM page_lengths l WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.source_file = l.source_file AND c.page = l.page_num))"""
COVERAGE_SQL = """SELECT source_file, n_pages, n_pages - n_blank - n_suspect AS n_with_chunks, n_blank, n_suspect, round((n_pages - n_blank - n_suspect) / n_pages * 100, 4) AS coverage_pct
 FROM (SELECT source_file, count(*) AS n_pages FROM page_lengths GROUP BY 1) LEFT JOIN (SELECT source_file, count(*) FILTER (WHERE n_chars < 100) AS b, count(*) FILTER (WHERE n_chars >= 100) AS s FROM gaps GROUP BY 1) USING (source_file),
 LATERAL (SELECT coalesce(b, 0) AS n_blank, coalesce(s, 0) AS n_suspect)"""


def _chunks_wide(spark, sf):
    return D.chunks(spark, sf).withColumn("page", F.col("page").cast("bigint"))


@query("page_coverage", with_chunks(f", {PAGE_LENGTHS} {COVERAGE_SQL}"))
def page_coverage(spark, sf):
    return Z.page_coverage(page_lengths(spark, sf), _chunks_wide(spark, sf))


@query("page_ranges", with_chunks(f", {PAGE_LENGTHS} SELECT source_file, min(page_num) AS first_page, max(page_num) AS last_page FROM (SELECT source_file, page_num, page_num - row_number() OVER (PARTITION BY source_file ORDER BY page_num) AS island FROM gaps) GROUP BY source_file, island"))
def page_ranges(spark, sf):
    return Z.page_ranges(Z.uncovered_pages(page_lengths(spark, sf), _chunks_wide(spark, sf)))
