"""Registered queries: pages, names, segments and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions import names as N
from docspark.functions import pages as G
from docspark.functions import text as X
from docspark.operators import chunking as C
from docspark.plans import derived as D
from docspark.plans.oracle import base as B
from docspark.plans.oracle.base import q, strip, with_chunks, with_corpus, with_segments
from docspark.plans.registry import query

# --- pages -------------------------------------------------------------------------------------------------
RAW_PAGES = """
raw_pages AS (SELECT doc_id, source_file, page_num, '- ' || page_num || ' -' || chr(10) || text || chr(10) || chr(10) || page_num AS text
 FROM (SELECT doc_id, source_file, p + 1 AS page_num, substr(text, p * 3000 + 1, 3000) AS text
  FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 2999) // 3000))) AS p FROM corpus)))
"""


def raw_documents(spark, sf):
    """Corpus with a page number line above and below every page."""
    numbered = F.transform(
        "pages",
        lambda p: F.struct(
            p["page_num"].alias("page_num"),
            F.concat(F.lit("- "), p["page_num"].cast("string"), F.lit(" -\n"), p["text"], F.lit("\n\n"),
                     p["page_num"].cast("string")).alias("text"),
        ),
    )
    return D.corpus(spark, sf).withColumn("pages", numbered)


def raw_pages(spark, sf):
    rows = raw_documents(spark, sf).select("doc_id", "source_file", F.explode("pages").alias("p"))
    return rows.select("doc_id", "source_file", F.col("p.page_num").cast("bigint").alias("page_num"), F.col("p.text").alias("text"))


def _run(line):
    s = strip(line)
    return f"({s} = '' OR regexp_matches({s}, {q(P.RUNNING_NUMBER)}) OR (length({s}) <= 5 AND regexp_matches({s}, '\\d')))"


def _lead(f, limit):
    whens = " ".join(
        f"WHEN len({f}) >= {n} AND list_bool_and({f}[1:{n}]) THEN {n}" for n in range(limit, 0, -1)
    )
    return f"CASE {whens} ELSE 0 END"


def clean_sql(text):
    return (
        f"(SELECT {strip('array_to_string(l_[h_ + 1:len(l_) - t_], chr(10))')} FROM (SELECT l_, {_lead('f_', 2)} AS h_, {_lead('list_reverse(f_)', 3)} AS t_ "
        f"FROM (SELECT l_, list_transform(l_, lambda z: {_run('z')}) AS f_ FROM (SELECT string_split_regex({text}, {q(P.LINE_BREAKS)}) AS l_))))"
    )


def headed_sql(text):
    s = strip("z")
    return (
        f"array_to_string(list_transform(string_split_regex({text}, {q(P.LINE_BREAKS)}), lambda z: CASE WHEN regexp_matches({s}, {q(P.HEADING_ARTICLE)}) "
        f"THEN chr(10) || '## ' || {s} WHEN (regexp_matches({s}, {q(P.HEADING_APPENDIX)}) AND length({s}) < 30) OR "
        f"(regexp_matches({s}, {q(P.HEADING_ADDENDUM)}) AND length({s}) < 20) THEN chr(10) || '### ' || {s} ELSE z END), chr(10))"
    )


_CLEAN = f"cleaned AS (SELECT doc_id, source_file, page_num, {clean_sql('text')} AS body FROM raw_pages)"


@query("strip_running_heads", with_corpus("SELECT doc_id, page_num, body FROM cleaned", RAW_PAGES, _CLEAN))
def strip_running_heads(spark, sf):
    return raw_pages(spark, sf).select("doc_id", "page_num", G.strip_running_heads(F.col("text")).alias("body"))


@query("md_headings", with_corpus(f"SELECT doc_id, page_num, {headed_sql('body')} AS body FROM cleaned", RAW_PAGES, _CLEAN))
def md_headings(spark, sf):
    rows = raw_pages(spark, sf).withColumn("clean", G.strip_running_heads(F.col("text")))
    return rows.select("doc_id", "page_num", G.md_headings(F.col("clean")).alias("body"))


@query("export_markdown", with_corpus(
    f"""SELECT doc_id, source_file, regexp_replace('# ' || regexp_replace(source_file, '\\.[^.]+$', '') || chr(10) || chr(10) || '> 출처: ' || source_file || chr(10) || chr(10) || '---' || chr(10) || chr(10)
 || string_agg(chr(10) || '<!-- PAGE ' || page_num || ' -->' || chr(10) || CASE WHEN body = '' THEN '' ELSE chr(10) || {headed_sql('body')} END, chr(10) ORDER BY page_num), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS markdown
 FROM cleaned GROUP BY doc_id, source_file""", RAW_PAGES, _CLEAN))
def export_markdown(spark, sf):
    return raw_documents(spark, sf).select(
        "doc_id", "source_file", G.markdown_document(F.col("source_file"), F.col("pages")).alias("markdown")
    )


@query("dump_raw_pages", with_corpus(
    "SELECT doc_id, string_agg('=== PAGE ' || page_num || ' ===' || chr(10) || text || chr(10) || chr(10), '' ORDER BY page_num) AS dump FROM raw_pages GROUP BY doc_id", RAW_PAGES))
def dump_raw_pages(spark, sf):
    return raw_documents(spark, sf).select("doc_id", G.raw_dump(F.col("pages")).alias("dump"))


_BARE_PAGES = "SELECT doc_id, p + 1 AS page_num, substr(text, p * 3000 + 1, 3000) AS text FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 2999) // 3000))) AS p FROM corpus)"


@query("flag_ocr_pages", with_corpus(
    f"""SELECT doc_id, count(*) AS n_pages, coalesce(string_agg(CASE WHEN length({strip('text')}) < 50 THEN page_num::VARCHAR END, ',' ORDER BY page_num), '') AS flagged
 FROM ({_BARE_PAGES}) GROUP BY doc_id"""))
def flag_ocr_pages(spark, sf):
    flagged = F.filter("pages", lambda p: G.needs_ocr(p["text"]))
    return D.corpus(spark, sf).select(
        "doc_id", F.size("pages").cast("bigint").alias("n_pages"),
        F.array_join(F.transform(flagged, lambda p: p["page_num"].cast("string")), ",").alias("flagged"),
    )


_PARSED_SQL = "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '  텍스트 추출 오류: ' || text WHEN doc_id % 13 = 1 THEN ' ' || chr(10) ELSE text END AS text FROM documents"


@query("failed_parse_filter", f"SELECT doc_id, length(text) AS n_chars FROM ({_PARSED_SQL}) WHERE NOT (length({strip('text')}) = 0 OR "
       + " OR ".join(f"starts_with(left(ltrim(text), 50), {q(m)})" for m in P.PARSE_FAILURES) + ")")
def failed_parse_filter(spark, sf):
    d = D.table(spark, sf, "documents")
    text = (
        F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("  텍스트 추출 오류: "), "text"))
        .when(F.col("doc_id") % 13 == 1, " \n").otherwise(F.col("text"))
    )
    rows = d.select("doc_id", text.alias("text")).filter(~G.looks_failed(F.col("text")))
    return rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query("parse_validation", with_corpus(
    f"""SELECT doc_id, len(regexp_extract_all(text, {q(P.ARTICLE_TOKEN)})) AS n_articles, len(regexp_extract_all(text, {q(P.APPENDIX_TOKEN)})) AS n_appendices,
 len(regexp_extract_all(text, {q(P.ADDENDUM_TOKEN)})) AS n_addenda, NOT regexp_matches(text, {q(P.ARTICLE_TOKEN)}) AS warn FROM corpus"""))
def parse_validation(spark, sf):
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "")
    rows = D.corpus(spark, sf).select("doc_id", text.alias("text"))
    return rows.select("doc_id", *[c.alias(n) for n, c in G.structure_counts(F.col("text")).items()])


def _cells(text):
    return F.transform(
        F.split(text, "\n"),
        lambda line: F.transform(F.split(line, " "), lambda w: F.when(F.length(w) >= 3, F.concat(F.lit(" "), w))),
    )


_CELLS = "list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(l, ' '), lambda w: CASE WHEN length(w) >= 3 THEN ' ' || w END))"
_ROW = f"array_to_string(list_transform(row_, lambda c: {strip(chr(99) + 'oalesce(c, ' + chr(39) * 2 + ')')}), ' | ')"


@query("table_to_text", f"""SELECT doc_id, array_to_string(list_transform(cells, lambda row_: {_ROW}), chr(10)) AS plain,
 '| ' || {_ROW.replace('row_', 'cells[1]')} || ' |' || chr(10) || '| ' || array_to_string(list_transform(cells[1], lambda c: '---'), ' | ') || ' |'
 || array_to_string(list_transform(cells[2:], lambda row_: chr(10) || '| ' || {_ROW} || ' |'), '') AS markdown
 FROM (SELECT doc_id, {_CELLS} AS cells FROM documents)""")
def table_to_text(spark, sf):
    d = D.spread(D.table(spark, sf, "documents")).select("doc_id", _cells(F.col("text")).alias("cells"))
    return d.select("doc_id", G.table_text(F.col("cells")).alias("plain"), G.table_markdown(F.col("cells")).alias("markdown"))


# --- names -------------------------------------------------------------------------------------------------
STEMS = """SELECT doc_id, CASE doc_id % 8
 WHEN 0 THEN '혁신법 시행령(대통령령)(제33310호)(20230' || (doc_id % 9 + 1) || '15)'
 WHEN 1 THEN '[별지 ' || (doc_id % 30) || '] 신청서(혁신법 시행규칙 서식)(20240101)'
 WHEN 2 THEN '[별표 2] 사용용도(제20조 관련)(국가연구개발혁신법 시행령)'
 WHEN 3 THEN source || ' 운영요령(2023)'
 WHEN 4 THEN '보안관리요령 (산업통상부고시 제2023-' || (100000 + doc_id) || '호)'
 WHEN 5 THEN source || ' 매뉴얼 (배포용 본권)'
 WHEN 6 THEN '국가연구개발혁신법(법률)(제' || doc_id || '호)'
 ELSE source || ' ' || lang || ' Manual(' || doc_id || ')' END AS stem FROM documents"""


def stems(spark, sf):
    d = D.table(spark, sf, "documents")
    i = F.col("doc_id")
    t = i.cast("string")
    forms = [
        F.concat(F.lit("혁신법 시행령(대통령령)(제33310호)(20230"), (i % 9 + 1).cast("string"), F.lit("15)")),
        F.concat(F.lit("[별지 "), (i % 30).cast("string"), F.lit("] 신청서(혁신법 시행규칙 서식)(20240101)")),
        F.lit("[별표 2] 사용용도(제20조 관련)(국가연구개발혁신법 시행령)"),
        F.concat("source", F.lit(" 운영요령(2023)")),
        F.concat(F.lit("보안관리요령 (산업통상부고시 제2023-"), (i + 100000).cast("string"), F.lit("호)")),
        F.concat("source", F.lit(" 매뉴얼 (배포용 본권)")),
        F.concat(F.lit("국가연구개발혁신법(법률)(제"), t, F.lit("호)")),
        F.concat("source", F.lit(" "), "lang", F.lit(" Manual("), t, F.lit(")")),
    ]
    return d.select("doc_id", F.get(F.array(*forms), (i % 8).cast("int")).alias("stem"))


_DATE = r"regexp_replace(regexp_extract(stem, '\((\d{8})\)', 1), '^(\d{4})(\d{2})(\d{2})$', '\1-\2-\3')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(stem, {q(p)}) THEN {q(v)}" for p, v in P.DOC_TYPE_RULES) + f" ELSE {q(P.DOC_TYPE_DEFAULT)} END"
_NAMED = (
    "named AS (SELECT doc_id, stem, a_, regexp_extract(a_, '" + r"\(([^)]{5,})\)\s*$" + "', 1) AS inner_, "
    + strip("regexp_replace(a_, '" + r"\s*\([^)]*\)\s*$" + "', '')") + " AS bare_ FROM (SELECT *, "
    + strip("regexp_replace(" + strip("regexp_replace(stem, '" + r"\s*\([^)]*\d{6,}[^)]*\)\s*$" + "', '')") + ", '" + r"\s*\([^)]*\d{4}\)\s*$" + "', '')")
    + f" AS a_ FROM ({STEMS})))"
)
_CLEANED = "CASE WHEN inner_ <> '' AND NOT regexp_matches(inner_, '\\d') THEN " + strip("inner_") + " WHEN bare_ <> '' THEN bare_ ELSE stem END"
_PARENTS = r"list_filter(regexp_extract_all(stem, '\(([^)]+)\)', 1), lambda s: NOT regexp_matches(s, '\d{6,}') AND length(s) > 4)"
_DOC_NAME = f"CASE WHEN regexp_matches(stem, {q(P.ATTACHMENT_NAME)}) AND len({_PARENTS}) > 0 THEN {_PARENTS}[-1] ELSE {_CLEANED} END"


@query("extract_date", f"SELECT doc_id, {_DATE} AS date FROM ({STEMS})")
def extract_date(spark, sf):
    return stems(spark, sf).select("doc_id", N.extract_date(F.col("stem")).alias("date"))


@query("infer_doc_type", f"SELECT doc_id, {_KIND} AS doc_type FROM ({STEMS})")
def infer_doc_type(spark, sf):
    return stems(spark, sf).select("doc_id", N.infer_doc_type(F.col("stem")).alias("doc_type"))


@query("clean_doc_name", f"WITH {_NAMED} SELECT doc_id, {_CLEANED} AS name FROM named")
def clean_doc_name(spark, sf):
    return stems(spark, sf).select("doc_id", N.clean_doc_name(F.col("stem")).alias("name"))


@query("doc_metadata", f"WITH {_NAMED} SELECT doc_id, {_DOC_NAME} AS doc_name, {_KIND} AS doc_type, {_DATE} AS effective_date, {_DATE} AS revised_date, true AS is_current FROM named")
def doc_metadata(spark, sf):
    return stems(spark, sf).select("doc_id", *[c.alias(n) for n, c in N.doc_metadata(F.col("stem")).items()])


@query("nfc", "SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS text_md5 FROM documents")
def nfc(spark, sf):
    d = D.spread(D.table(spark, sf, "documents"))
    apart = F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301"))
    return d.select("doc_id", F.md5(N.nfc(apart).cast("binary")).alias("text_md5"))


# --- splitting and packing ---------------------------------------------------------------------------------
def _pieces(rows, parts):
    return rows.select("doc_id", F.posexplode(parts).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("bigint"))


_UNNEST = "SELECT doc_id, unnest(range(0, len(p_))) AS pos, unnest(p_) AS piece FROM"


@query("greedy_pack", f"{_UNNEST} (SELECT doc_id, string_split({B.packed('string_split(text, chr(10))')}, chr(1)) AS p_ FROM documents)")
def greedy_pack(spark, sf):
    d = D.spread(D.table(spark, sf, "documents"))
    return _pieces(d, X.pack(F.split("text", "\n")))


@query("split_lines_hard", f"{_UNNEST} (SELECT doc_id, string_split({B.packed(B.cut_lines('text'))}, chr(1)) AS p_ FROM documents)")
def split_lines_hard(spark, sf):
    return _pieces(D.spread(D.table(spark, sf, "documents")), X.split_lines(F.col("text")))


@query("split_items", with_corpus(
    f"{_UNNEST} (SELECT doc_id, list_filter({B.cut_items('text', P.APPENDIX_ITEM_MARKERS)}, lambda s: length({strip('s')}) > 0) AS p_ FROM corpus)"))
def split_items(spark, sf):
    rows = D.corpus(spark, sf).withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), ""))
    return _pieces(rows, X.split_items(F.col("text"), P.APPENDIX_ITEM_MARKERS))


# --- segments and chunks -----------------------------------------------------------------------------------
_SEG = "SELECT doc_id, seg_no, label, title, page::BIGINT AS page, start, \"end\", seg_text FROM segments"


def _segments(spark, sf):
    return D.materialize(spark, "segments", sf, lambda: C.split_segments(D.corpus(spark, sf)))


def _route(spark, sf, name):
    rows = _segments(spark, sf).filter(F.col("route") == name)
    return rows.select(
        "doc_id", F.col("seg_no").cast("bigint").alias("seg_no"), "label", "title",
        *[F.col(c).cast("bigint").alias(c) for c in ("page", "start", "end")], "seg_text",
    )


for _name, _key in (("articles", "split_articles"), ("appendix", "split_appendix"), ("manual", "split_pages"), ("faq", "split_faq")):
    query(_key, with_segments(f"{_SEG} WHERE route = '{_name}'"))(lambda spark, sf, r=_name: _route(spark, sf, r))


@query("article_title", with_segments("SELECT doc_id, seg_no, label, title FROM segments WHERE route = 'articles' AND label NOT IN ('', '서문')"))
def article_title(spark, sf):
    rows = _route(spark, sf, "articles").filter(~F.col("label").isin("", P.PREAMBLE_LABEL))
    return rows.select("doc_id", "seg_no", "label", "title")


@query("appendix_title", with_segments("SELECT doc_id, title FROM segments WHERE route = 'appendix'"))
def appendix_title(spark, sf):
    return _route(spark, sf, "appendix").select("doc_id", "title")


@query("drop_short", with_segments(f"SELECT route, count(*) FILTER (WHERE length(seg_text) >= 20) AS n_kept, count(*) FILTER (WHERE length(seg_text) < 20) AS n_dropped FROM segments GROUP BY route"))
def drop_short(spark, sf):
    short = F.length("seg_text") < P.MIN_CHUNK_LEN
    return _segments(spark, sf).groupBy("route").agg(
        F.count(F.when(~short, 1)).alias("n_kept"), F.count(F.when(short, 1)).alias("n_dropped")
    )


@query("offset_to_page", with_segments(f"SELECT doc_id, seg_no, start, {B.page_at('start')} AS page FROM segments"))
def offset_to_page(spark, sf):
    return _segments(spark, sf).select(
        "doc_id", F.col("seg_no").cast("bigint").alias("seg_no"), F.col("start").cast("bigint").alias("start"),
        X.offset_to_page(F.col("start"), F.col("boundaries")).cast("bigint").alias("page"),
    )


@query("part_labels", with_chunks("SELECT chunk_id, article_no FROM chunks WHERE contains(article_no, ' (part ')"))
def part_labels(spark, sf):
    return D.chunks(spark, sf).filter(F.contains("article_no", F.lit(" (part "))).select("chunk_id", "article_no")


@query("part_page", with_chunks("SELECT chunk_id, page FROM chunks WHERE contains(article_no, ' (part ')"))
def part_page(spark, sf):
    parts = D.chunks(spark, sf).filter(F.contains("article_no", F.lit(" (part ")))
    return parts.select("chunk_id", F.col("page").cast("bigint").alias("page"))


@query("parent_label", with_chunks("SELECT chunk_id, split_part(article_no, ' (part ', 1) AS parent, coalesce(try_cast(regexp_extract(article_no, '" + r"\(part (\d+)/\d+\)" + "', 1) AS BIGINT), 0) AS part FROM chunks"))
def parent_label(spark, sf):
    return D.chunks(spark, sf).select("chunk_id", X.parent_label(F.col("article_no")).alias("parent"), X.part_number(F.col("article_no")).alias("part"))


@query("chunk_document", with_chunks("SELECT chunk_id, doc_name, doc_type, article_no, article_title, page, source_file, text FROM chunks"))
def chunk_document(spark, sf):
    rows = C.chunk_documents(D.corpus(spark, sf))
    return rows.select(
        "chunk_id", "doc_name", "doc_type", "article_no", "article_title", F.col("page").cast("bigint").alias("page"), "source_file", "text"
    )
