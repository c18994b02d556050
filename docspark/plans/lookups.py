"""Registered queries: lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions.names import nfc
from docspark.operators import lookup as L
from docspark.plans import derived as D
from docspark.plans.oracle.base import page_at, strip, with_corpus
from docspark.plans.registry import query

_BARE = "bare AS (SELECT doc_id, source_file, p + 1 AS page_num, substr(text, p * 3000 + 1, 3000) AS text FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 2999) // 3000))) AS p FROM corpus))"


def pages(spark, sf):
    rows = D.corpus(spark, sf).select("doc_id", "source_file", F.explode("pages").alias("p"))
    return rows.select("doc_id", "source_file", F.col("p.page_num").cast("bigint").alias("page_num"), F.col("p.text").alias("text"))


@query("list_documents", with_corpus(" SELECT source_file AS name, CASE WHEN ends_with(source_file, '.hwp') THEN 'hwp' ELSE 'pdf' END AS type, CASE WHEN ends_with(source_file, '.hwp') THEN 1 ELSE count(*) END AS pages FROM bare GROUP BY source_file", _BARE))
def list_documents(spark, sf):
    return L.list_documents(D.corpus(spark, sf))


_ASKED = """asked AS (SELECT DISTINCT doc_name, lower(trim(doc_name)) AS fullname, regexp_replace(lower(trim(doc_name)), '(.)\\.[^.]+$', '\\1') AS stem FROM (
 SELECT CASE lang WHEN 'en' THEN source_file WHEN 'fr' THEN regexp_replace(source_file, '\\.[^.]+$', '') WHEN 'de' THEN upper(source || '_' || doc_id) ELSE '혁신법 ' || source || '_' || doc_id END AS doc_name
 FROM corpus JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id) UNION ALL SELECT url FROM pages)),
have AS (SELECT source_file AS name, lower(source_file) AS lname, regexp_replace(lower(source_file), '(.)\\.[^.]+$', '\\1') AS lstem FROM corpus),
tiers AS (SELECT doc_name, name, CASE WHEN fullname = lname THEN 1 WHEN stem = lstem THEN 2 WHEN contains(lstem, stem) THEN 3
   WHEN list_bool_and(list_transform(list_filter(string_split_regex(fullname, '\\s+'), lambda w: length(w) >= 2), lambda w: contains(lname, w))) THEN 4 END::BIGINT AS tier, lstem FROM asked, have)"""


def doc_requests(spark, sf):
    docs = D.corpus(spark, sf).select("doc_id", "source_file").join(D.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    tail = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    name = (
        F.when(F.col("lang") == "en", F.col("source_file")).when(F.col("lang") == "fr", F.regexp_replace("source_file", r"\.[^.]+$", ""))
        .when(F.col("lang") == "de", F.upper(tail)).otherwise(F.concat(F.lit("혁신법 "), tail))
    )
    return docs.select(name.alias("doc_name")).unionByName(D.table(spark, sf, "pages").select(F.col("url").alias("doc_name"))).distinct()


@query("resolve_doc_name", with_corpus(""" SELECT doc_name, name, tier FROM asked LEFT JOIN (
 SELECT doc_name, name, tier, row_number() OVER (PARTITION BY doc_name ORDER BY tier, CASE WHEN tier = 3 THEN length(lstem) ELSE 0 END, CASE WHEN tier = 3 THEN lstem ELSE '' END, name) AS rn FROM tiers WHERE tier IS NOT NULL) t USING (doc_name) WHERE coalesce(rn, 1) = 1""", _ASKED))
def resolve_doc_name(spark, sf):
    docs = D.corpus(spark, sf).select(F.col("source_file").alias("name"))
    return L.resolve_doc_name(doc_requests(spark, sf), docs, nfc).select("doc_name", "name", "tier")


# --- pages -------------------------------------------------------------------------------------------------
_PAGE_REQ = """req AS (SELECT doc_id AS request_id, CASE WHEN n_chars % 11 = 0 THEN 'absent_' || source_file ELSE source_file END AS source_file,
 CASE WHEN n_chars % 7 = 0 THEN 'x' ELSE (n_chars % 4)::VARCHAR END AS page_num FROM corpus JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"""
_READ = """read AS (SELECT request_id, source_file, CASE WHEN hwp AND error IS NULL THEN 1 ELSE coalesce(num, 0) END AS page, text, length(text) AS char_count, error FROM (
 SELECT *, CASE WHEN error IS NOT NULL THEN '' WHEN hwp THEN t1 ELSE tn END AS text FROM (
  SELECT request_id, r.source_file, num, hwp, p1.text AS t1, pn.text AS tn, CASE WHEN p1.text IS NULL THEN 'not_found' WHEN hwp THEN NULL WHEN num IS NULL THEN 'not_integer' WHEN pn.text IS NULL THEN 'out_of_range' END AS error
  FROM (SELECT *, try_cast(page_num AS BIGINT) AS num, ends_with(source_file, '.hwp') AS hwp FROM req) r LEFT JOIN bare p1 ON p1.source_file = r.source_file AND p1.page_num = 1 LEFT JOIN bare pn ON pn.source_file = r.source_file AND pn.page_num = num)))"""


def _page_results(spark, sf):
    docs = D.corpus(spark, sf)
    n = D.table(spark, sf, "documents").select("doc_id", "n_chars")
    req = docs.select("doc_id", "source_file").join(n, "doc_id").select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("n_chars") % 11 == 0, F.concat(F.lit("absent_"), "source_file")).otherwise(F.col("source_file")).alias("source_file"),
        F.when(F.col("n_chars") % 7 == 0, "x").otherwise((F.col("n_chars") % 4).cast("string")).alias("page_num"),
    )
    return L.read_page(req, docs)


@query("read_page", with_corpus(" SELECT * FROM read", _BARE, _PAGE_REQ, _READ))
def read_page(spark, sf):
    return _page_results(spark, sf)


VERIFIED = "verified AS (SELECT request_id, 'read_page' AS kind, CASE WHEN request_id % 2 = 0 THEN error IS NOT NULL AND text = '' ELSE text <> '' AND error IS NULL AND contains(text, '혁신법') END AS ok FROM read)"
LOOKUP_CTES = (_BARE, _PAGE_REQ, _READ, VERIFIED)


def verified(spark, sf):
    """Even requests expect an error, odd ones a page that names the law."""
    rows = _page_results(spark, sf).withColumn("expect_error", F.col("request_id") % 2 == 0).withColumn("expect_keywords", F.array(F.lit("혁신법")))
    return L.verify_lookups(rows).select("request_id", F.lit("read_page").alias("kind"), "ok")


@query("verify_lookups", with_corpus(" SELECT * FROM verified", *LOOKUP_CTES))
def verify_lookups(spark, sf):
    return verified(spark, sf)


@query("search_text", with_corpus(""" SELECT request_id, source_file, page_num AS page, m AS "match", replace(substr(text, greatest(pos - 30, 1), pos + length(m) + 30 - greatest(pos - 30, 1)), chr(10), ' ') AS excerpt, rank FROM (
 SELECT *, regexp_extract(text, pat) AS m, instr(text, regexp_extract(text, pat)) AS pos, row_number() OVER (PARTITION BY request_id ORDER BY page_num) AS rank
 FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN '(?i)제\\d+조의\\d' WHEN 1 THEN '(?i)연구활동비를 사' ELSE '(?i)별표 1\\(' END AS pat, doc_id AS request_id FROM bare) WHERE regexp_matches(text, pat)) WHERE rank <= 5""", _BARE))
def search_text(spark, sf):
    docs = D.corpus(spark, sf)
    query_text = F.when(F.col("doc_id") % 3 == 0, r"제\d+조의\d").when(F.col("doc_id") % 3 == 1, "연구활동비를 사").otherwise("별표 1(")
    req = docs.select(F.col("doc_id").alias("request_id"), "source_file", query_text.alias("query"))
    return L.search_text(req, pages(spark, sf).drop("doc_id"))


_LOOK = r"(?m)(^\s*제\d+조(?:의\d+)?|^[\s■◎●]*별표\s*\d+|^[\s■◎●]*별표|^\s*부\s*칙)([ \t\r\f\v]*$|\s*\()"


def _mark(text):
    return f"regexp_replace({text}, '{_LOOK}', chr(1) || '\\1' || chr(2) || '\\2', 'g')"


@query("list_articles", with_corpus(f""" SELECT source_file, page_num AS page, pos - 1 AS pos, {strip("regexp_replace(split_part(segs[pos + 1], chr(2), 1), '^[" + chr(92) + "s■◎●]+', '')")} AS article_no
 FROM (SELECT *, unnest(range(1, len(segs))) AS pos FROM (SELECT source_file, page_num, string_split({_mark('text')}, chr(1)) AS segs FROM bare))""", _BARE))
def list_articles(spark, sf):
    return L.list_articles(D.corpus(spark, sf))


_SPAN = f"""
whole AS (SELECT doc_id, any_value(source_file) AS source_file, string_agg(text, chr(10) ORDER BY page_num) AS full_text, list(text ORDER BY page_num) AS texts, list(start ORDER BY page_num) AS starts, list(page_num ORDER BY page_num) AS nums
  FROM (SELECT *, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_num) - length(text) - 1)::BIGINT AS start FROM bare) GROUP BY doc_id),
req AS (SELECT doc_id AS request_id, source_file, full_text, texts, starts, nums, CASE doc_id % 3 WHEN 0 THEN '제 ' || (doc_id % 9 + 1) || '조' WHEN 1 THEN '부칙' ELSE '별표 ' || (doc_id % 9 + 1) END AS article_no FROM whole),
segs AS (SELECT *, (sum(length(seg)) OVER w - length(seg))::BIGINT AS start, sum(length(seg)) OVER w ::BIGINT AS stop FROM (
  SELECT request_id, n, replace(s[n], chr(2), '') AS seg, CASE WHEN n > 1 THEN regexp_replace(split_part(s[n], chr(2), 1), '[\\s■◎●]', '', 'g') END AS label
  FROM (SELECT request_id, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT request_id, string_split({_mark('full_text')}, chr(1)) AS s FROM req))) WINDOW w AS (PARTITION BY request_id ORDER BY n)),
first_hit AS (SELECT request_id, arg_min(start, n) AS start, arg_min(stop, n) AS stop FROM segs JOIN req USING (request_id) WHERE label = regexp_replace(article_no, '\\s+', '', 'g') GROUP BY 1),
spans AS (SELECT *, coalesce({strip('substr(full_text, start + 1, stop - start)')}, '') AS body, list_filter(nums, lambda p: regexp_matches(texts[p], '(?i)' || CASE WHEN starts_with(article_no, '제') THEN regexp_replace(article_no, '\\s+', '', 'g') ELSE article_no END))[1:5] AS named,
  ends_with(source_file, '.hwp') AS hwp FROM req LEFT JOIN first_hit USING (request_id))
"""


@query("article_span", with_corpus(f""" SELECT request_id, source_file, article_no, CASE WHEN length(body) >= 100 THEN body WHEN hwp AND len(named) > 0 THEN {strip('texts[1]')}
  ELSE {strip("array_to_string(list_transform(named[1:3], lambda p: '=== p.' || p || ' ===' || chr(10) || texts[p]), chr(10) || chr(10))")} END AS text,
 CASE WHEN hwp AND (length(body) >= 100 OR len(named) > 0) THEN 1 WHEN length(body) >= 100 THEN {page_at('start')} WHEN len(named) > 0 THEN named[1] ELSE 0 END AS start_page,
 CASE WHEN hwp AND (length(body) >= 100 OR len(named) > 0) THEN 1 WHEN length(body) >= 100 THEN {page_at('greatest(start, stop - 1)')} WHEN len(named) > 0 THEN named[-1] ELSE 0 END AS end_page,
 CASE WHEN length(body) >= 100 THEN 'header' WHEN len(named) > 0 THEN 'fallback' ELSE 'none' END AS matched_via FROM spans""", _BARE, _SPAN))
def article_span(spark, sf):
    docs = D.corpus(spark, sf)
    i = F.col("doc_id")
    number = (i % 9 + 1).cast("string")
    label = F.when(i % 3 == 0, F.concat(F.lit("제 "), number, F.lit("조"))).when(i % 3 == 1, "부칙").otherwise(F.concat(F.lit("별표 "), number))
    return L.article_span(docs.select(i.alias("request_id"), "source_file", label.alias("article_no")), docs)
