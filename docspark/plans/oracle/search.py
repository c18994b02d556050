"""Shared SQL for questions, tokens, vectors and candidate lists."""

from __future__ import annotations

from docspark import profiles as P
from docspark.functions.tokens import LONG_PARTICLE, SHORT_PARTICLE
from docspark.operators.hints import CHAT_DEFAULT, PAIRS
from docspark.plans.oracle.base import CHUNKS, CORPUS, SEGMENTS, in_list, q, strip


def distinct(items: str) -> str:
    """Distinct list in order of first appearance."""
    return f"(SELECT list_filter(x_, lambda v_, i_: list_position(x_, v_) = i_) FROM (SELECT {items} AS x_))"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {q(P.TOKEN_SEPARATOR)}), lambda w_: w_ <> '')"


def tokens(text: str) -> str:
    normal = (
        f"CASE WHEN NOT regexp_matches(w, '[가-힣]') THEN lower(w) WHEN regexp_replace(w, {q(LONG_PARTICLE)}, '\\1') <> w "
        f"THEN regexp_replace(w, {q(LONG_PARTICLE)}, '\\1') ELSE regexp_replace(w, {q(SHORT_PARTICLE)}, '\\1') END"
    )
    return f"list_filter(list_transform({words(text)}, lambda w: {normal}), lambda t: length(t) >= 2)"


QUESTIONS = """
questions AS (
 SELECT item_id AS question_id, text || CASE item_id % 6
   WHEN 0 THEN ' 제' || (item_id % 30 + 1) || '조의' || (item_id % 3 + 1) || ' 제2항 사용용도는?'
   WHEN 1 THEN ' 별표 ' || (item_id % 30 + 1) || ' 연구활동비를 사용 가능'
   WHEN 2 THEN ' 종전 규정과 달라진 비목 연구활동비는 비교'
   WHEN 3 THEN ' ' || (item_id % 5 + 1) || 'p 혹은 제' || (item_id % 30 + 1) || ' 조 제3호'
   WHEN 4 THEN ' 별지 3 제7절 시행령에서는 제 ' || (item_id % 30 + 1) || '조'
   ELSE ' 비목' END AS question
 FROM benchmark
)
"""

MODEL = """
model AS (
 SELECT item_id AS question_id,
  CASE item_id % 7 WHEN 0 THEN 'article_lookup' WHEN 1 THEN 'comparison' WHEN 2 THEN 'chat' WHEN 3 THEN 'unknown' ELSE 'open' END AS kind,
  CASE WHEN item_id % 14 = 2 THEN ' 안녕하세요 ' ELSE '' END AS chat_response,
  CASE WHEN item_id % 5 = 0 THEN [item_id % 4, 12000] ELSE [] END AS target_pages,
  CASE WHEN item_id % 3 = 0 THEN [' 제' || (item_id % 30 + 1) || '조 ', ''] ELSE [] END AS target_articles,
  []::VARCHAR[] AS target_paragraphs, []::VARCHAR[] AS target_items, []::VARCHAR[] AS target_appendices, []::VARCHAR[] AS target_forms,
  []::VARCHAR[] AS target_sections,
  CASE WHEN item_id % 4 = 1 THEN ['혁신법에서는', '비목'] ELSE [] END AS topic_keywords, item_id % 9 = 4 AS comparison_intent,
  CASE WHEN item_id % 4 = 0 THEN ' 시행규칙' ELSE '' END AS doc_name_hint,
  CASE WHEN item_id % 8 = 3 THEN '다시 ' || text ELSE '' END AS rewritten_query
 FROM benchmark
)
"""


def _found(pattern: str, before: str, after: str = "") -> str:
    return distinct(
        f"list_transform(regexp_extract_all(question, {q(pattern)}, 1), lambda m: {q(before)} || m || {q(after)})"
    )


def _keyword_cut(w: str) -> str:
    whens = " ".join(
        f"WHEN ends_with({w}, {q(p)}) AND length({w}) >= {len(p) + 2} THEN left({w}, length({w}) - {len(p)})"
        for p in P.KEYWORD_PARTICLES
    )
    return f"CASE {whens} ELSE {w} END"


_KEPT = (
    f"k IN {in_list(P.DOMAIN_KEYWORDS)} OR (length(k) >= 4 AND regexp_matches(k, '[가-힣]') AND k NOT IN "
    f"{in_list(P.STOPWORDS + P.CORPUS_STOPWORDS)})"
)
_TYPES = ", ".join(f"CASE WHEN contains(question, {q(s)}) THEN {q(k)} END" for s, k in P.DOC_TYPE_WORDS)
_COMPARES = " OR ".join(f"contains(question, {q(t)})" for t in P.COMPARISON_TRIGGERS)
_PAGE = r"(?i)(p\.?\s*\d{1,4}(?:[^\w가-힣]|$)|\d{1,4}\s*(?:p(?:[^\w가-힣]|$)|페이지|쪽))"

PARSED = f"""
parsed AS (
 SELECT question_id, question,
  {distinct("list_transform(regexp_extract_all(question, '제?" + chr(92) + "s*" + chr(92) + "d+" + chr(92) + "s*조(?:" + chr(92) + "s*의" + chr(92) + "s*" + chr(92) + "d+)?'), lambda m: '제' || regexp_replace(m, '[제" + chr(92) + "s]', '', 'g'))")} AS article_nos,
  {_found(r'제?\s*(\d+)\s*항', '제', '항')} AS paragraphs, {_found(r'제?\s*(\d+)\s*호', '제', '호')} AS items,
  {_found(r'별표\s*(\d+)', '별표')} AS appendices, {_found(r'별지\s*(\d+)', '별지')} AS forms, {_found(r'제?\s*(\d+)\s*절', '제', '절')} AS sections,
  {distinct(f"list_filter(list_transform({words('question')}, lambda w: {_keyword_cut('w')}), lambda k: {_KEPT})")} AS keywords,
  {distinct(f"list_filter([{_TYPES}], lambda t: t IS NOT NULL)")} AS doc_type_hints, ({_COMPARES}) AS comparison_intent,
  {distinct(f"list_filter(list_transform(regexp_extract_all(question, {q(_PAGE)}), lambda m: regexp_extract(m, '[0-9]+')::BIGINT), lambda n: n BETWEEN 1 AND 9999)")} AS target_pages
 FROM questions
)
"""


def _union(a: str, b: str) -> str:
    return distinct(f"list_filter(list_transform(list_concat({a}, {b}), lambda s: {strip('s')}), lambda s: length(s) > 0)")


_MERGED = ",\n  ".join(
    f"CASE WHEN k = 'chat' THEN [] ELSE {_union('m.' + other, 'p.' + name)} END AS {name}" for name, other in PAIRS.items()
)
HINTED = f"""
hinted AS (
 SELECT p.question_id, question, {_MERGED},
  CASE WHEN k = 'chat' THEN [] ELSE p.doc_type_hints END AS doc_type_hints,
  k <> 'chat' AND (m.comparison_intent OR p.comparison_intent) AS comparison_intent,
  CASE WHEN k = 'chat' THEN [] ELSE pages_all END AS target_pages,
  CASE WHEN k = 'chat' THEN '' ELSE trim(m.doc_name_hint) END AS doc_name_hint,
  CASE WHEN len(pages_all) > 0 AND k <> 'chat' THEN 'page_lookup' ELSE k END AS kind,
  CASE WHEN k <> 'chat' THEN '' ELSE coalesce(nullif(trim(m.chat_response), ''), {q(CHAT_DEFAULT)}) END AS chat_response,
  CASE WHEN k = 'chat' THEN '' WHEN trim(m.rewritten_query) = '' THEN question ELSE trim(m.rewritten_query) END AS rewritten_query
 FROM (SELECT *, {distinct("list_concat(list_filter(m0.target_pages, lambda n: n BETWEEN 1 AND 9999), p0.target_pages)")} AS pages_all,
   p0 AS p, m0 AS m, CASE WHEN trim(m0.kind) IN {in_list(P.QUESTION_KINDS)} THEN trim(m0.kind) ELSE 'open' END AS k
  FROM parsed p0 JOIN model m0 USING (question_id))
)
"""

_BUCKET = f"list_transform({{}}, lambda t: ('0x' || left(md5(t), 4))::BIGINT % 64)"


def _counts(tokens_sql: str) -> str:
    return (
        f"(SELECT list_transform(range(0, 64), lambda b: len(list_filter(b_, lambda x: x = b))::DOUBLE) FROM "
        f"(SELECT {_BUCKET.format(tokens_sql)} AS b_))"
    )


CHUNK_TOKENS = f"""
chunk_tokens AS MATERIALIZED (SELECT chunk_id, {tokens("text || ' ' || article_no || ' ' || article_title")} AS toks FROM chunks)
"""
VECTORS = f"""
vectors AS MATERIALIZED (SELECT chunk_id, {_counts('toks')} AS vec FROM chunk_tokens)
"""
ASKED = f"""
asked AS MATERIALIZED (SELECT *, {_counts(tokens("CASE WHEN rewritten_query <> '' THEN rewritten_query ELSE question END"))} AS qvec FROM hinted)
"""


def cosine(a: str, b: str) -> str:
    return f"round(coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0), 6)"


NEAREST = f"""
cos AS MATERIALIZED (SELECT question_id, chunk_id, {cosine('qvec', 'vec')} AS cosine FROM asked, vectors),
nearest AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, chunk_id) AS rank FROM cos) WHERE rank <= {P.FANOUT_CANDIDATES})
"""

BM25 = f"""
terms AS MATERIALIZED (SELECT chunk_id, len(toks) AS doc_len, unnest(toks) AS term FROM chunk_tokens),
postings AS MATERIALIZED (SELECT chunk_id, any_value(doc_len) AS doc_len, term, count(*) AS tf FROM terms GROUP BY chunk_id, term),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM chunk_tokens),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN {P.BM25_EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q_terms AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({tokens("CASE WHEN rewritten_query <> '' THEN rewritten_query ELSE question END")}) AS term FROM hinted) GROUP BY ALL),
bm25 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT question_id, chunk_id, round(sum(times * idf * tf * {P.BM25_K1 + 1} / (tf + {P.BM25_K1} * (1 - {P.BM25_B} + {P.BM25_B} * doc_len / avg_len))), 6) AS score
  FROM q_terms JOIN idf USING (term) JOIN postings USING (term), stats GROUP BY question_id, chunk_id) WHERE score > 0) WHERE rank <= {P.RRF_CANDIDATES})
"""


def _spaced(col: str, word: str) -> str:
    n = len(word) + 1
    return (
        f"flatten(list_transform({col}, lambda h: CASE WHEN starts_with(h, '{word}') AND trim(substr(h, {n})) <> '' "
        f"THEN [h, '{word} ' || trim(substr(h, {n}))] ELSE [h] END))"
    )


STRUCTURAL_STRINGS = distinct(
    f"list_concat(list_concat(article_nos, {_spaced('appendices', '별표')}), list_concat({_spaced('forms', '별지')}, sections))"
)
PHRASE_PAIRS = (
    "flatten(list_transform(keywords, lambda a, i: list_transform(keywords[i + 1:], lambda b: a || ' ' || b)))"
)


def _filter_rows(step: int, field: str, boost: float, phrases: str, scan: int, where: str = "true") -> str:
    return (
        f"SELECT question_id, {step} AS step, unnest(range(0, len(p_))) AS seq, unnest(p_) AS phrase, '{field}' AS field, "
        f"{boost} AS boost, {scan} AS scan_max FROM (SELECT question_id, {phrases} AS p_ FROM asked WHERE {where})"
    )


def label_match(label: str, s: str) -> str:
    return (
        f"contains({label}, {s}) AND (NOT regexp_matches({s}, '^제" + r"\d" + f"+조$') OR "
        f"contains(regexp_replace({label}, '제" + r"\d+조의\d+" + f"', chr(1), 'g'), {s}))"
    )


def text_match(text: str, phrase: str) -> str:
    return (
        f"list_bool_and(list_transform(list_filter(string_split_regex({phrase}, '" + r"\s+" + f"'), lambda t: t <> ''), "
        f"lambda t: contains({text}, t)))"
    )


FILTERS = f"""
filters AS MATERIALIZED (
 {_filter_rows(3, 'label', P.BOOST_STRUCTURAL, STRUCTURAL_STRINGS, P.SCAN_CANDIDATES)}
 UNION ALL {_filter_rows(4, 'text', P.BOOST_PHRASE_PAIR, PHRASE_PAIRS, P.PHRASE_SCAN_MAX)}
 UNION ALL {_filter_rows(5, 'text', P.BOOST_KEYWORD_AND, "[array_to_string(keywords, ' ')]", 0, "len(keywords) >= 2")}
 UNION ALL {_filter_rows(6, 'text', P.BOOST_COMPARISON, "['" + ' '.join(P.COMPARISON_WORDS) + "']", 0, "comparison_intent")}
 UNION ALL {_filter_rows(8, 'text', P.BOOST_KEYWORD, 'keywords', 0, "len(keywords) < 2")}
),
matches AS MATERIALIZED (
 SELECT field, phrase, chunk_id, row_number() OVER (PARTITION BY field, phrase ORDER BY chunk_id) AS place,
  count(*) OVER (PARTITION BY field, phrase) AS n_matches
 FROM (SELECT DISTINCT field, phrase FROM filters) JOIN chunks
  ON CASE WHEN field = 'label' THEN {label_match('article_no', 'phrase')} ELSE {text_match('text', 'phrase')} END
),
scored AS MATERIALIZED (SELECT f.*, chunk_id, cosine FROM filters f JOIN matches USING (field, phrase) JOIN cos USING (question_id, chunk_id))
"""
_CATEGORY = "CASE " + " ".join(f"WHEN contains(doc_name, {q(c)}) THEN {q(c)}" for c in P.COMPARISON_CATEGORIES) + " ELSE '' END"
CANDIDATES = f"""
candidates AS MATERIALIZED (
 SELECT question_id, 1 AS step, 0 AS seq, 0 AS sub, chunk_id, cosine AS score FROM nearest WHERE rank <= {P.VECTOR_CANDIDATES}
 UNION ALL
 SELECT question_id, 2, seq, 0, chunk_id, 1.5 FROM (SELECT question_id, unnest(range(0, len(target_pages))) AS seq, unnest(target_pages) AS page FROM asked)
  JOIN (SELECT page, chunk_id, row_number() OVER (PARTITION BY page ORDER BY chunk_id) AS rn FROM chunks) USING (page) WHERE rn <= {P.PAGE_CANDIDATES}
 UNION ALL
 SELECT question_id, step, seq, 0, chunk_id, round(cosine + boost, 6) FROM (SELECT *, row_number() OVER (PARTITION BY question_id, step, seq ORDER BY cosine DESC, chunk_id) AS rn FROM scored) WHERE rn <= {P.FILTERED_CANDIDATES}
 UNION ALL
 SELECT question_id, step, seq, 1, chunk_id, round(0.5 + boost, 6) FROM filters JOIN matches USING (field, phrase)
  WHERE (step = 3 AND place <= scan_max) OR (step = 4 AND n_matches <= scan_max)
 UNION ALL
 SELECT question_id, 7, 0, 0, chunk_id, round(cosine + {P.BOOST_FANOUT}, 6) FROM (
  SELECT question_id, chunk_id, cosine, row_number() OVER (PARTITION BY question_id, {_CATEGORY} ORDER BY cosine DESC, chunk_id) AS rn
  FROM nearest JOIN asked USING (question_id) JOIN chunks USING (chunk_id) WHERE comparison_intent AND {_CATEGORY} <> '') WHERE rn = 1
),
pooled AS MATERIALIZED (
 SELECT question_id, chunk_id, round(list_reduce(list(score::DOUBLE ORDER BY step, seq, sub), lambda a, x: greatest(a, x) + {P.REPEAT_BONUS}::DOUBLE), 6) AS score,
  count(*) AS n_sources FROM candidates GROUP BY question_id, chunk_id
),
boosted AS MATERIALIZED (
 SELECT question_id, chunk_id, doc_name, n_sources, comparison_intent, {_CATEGORY} AS category,
  CASE WHEN doc_name_hint <> '' AND contains(doc_name, doc_name_hint) THEN round(score + {P.BOOST_DOC_NAME}, 6) ELSE score END AS score
 FROM pooled JOIN asked USING (question_id) JOIN chunks USING (chunk_id)
),
smart_ranked AS (
 SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank,
  row_number() OVER (PARTITION BY question_id, category ORDER BY score DESC, chunk_id) AS place FROM boosted
),
chosen AS (SELECT question_id, list(category) AS have, count(*) AS n_selected FROM smart_ranked WHERE rank <= 8 GROUP BY question_id),
swaps AS (
 SELECT question_id, n_selected - row_number() OVER (PARTITION BY question_id ORDER BY list_position([{', '.join(q(c) for c in P.COMPARISON_CATEGORIES)}], category)) + 1 AS slot,
  chunk_id, score, doc_name, n_sources
 FROM smart_ranked JOIN chosen USING (question_id)
 WHERE comparison_intent AND rank > 8 AND place = 1 AND category <> '' AND NOT list_contains(have, category) AND n_selected >= 2
),
smart AS MATERIALIZED (
 SELECT question_id, rank AS slot, chunk_id, score, doc_name, n_sources FROM smart_ranked r WHERE rank <= 8
  AND NOT EXISTS (SELECT 1 FROM swaps s WHERE s.question_id = r.question_id AND s.slot = r.rank)
 UNION ALL SELECT * FROM swaps WHERE slot >= 1
)
"""
_SCAN_ONLY = "f.field = 'label' AND place <= " + str(P.SCAN_CANDIDATES)
STRUCTURAL = f"""
structural AS MATERIALIZED (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT question_id, chunk_id, coalesce(max(cosine), 0.5) AS score FROM (
   SELECT question_id, chunk_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY question_id, seq ORDER BY cosine DESC, chunk_id) AS rn FROM scored WHERE field = 'label') WHERE rn <= {P.FILTERED_CANDIDATES}
   UNION ALL SELECT f.question_id, chunk_id, NULL FROM filters f JOIN matches USING (field, phrase) WHERE {_SCAN_ONLY})
  GROUP BY question_id, chunk_id)) WHERE rank <= {P.RRF_CANDIDATES}
)
"""
FUSED = f"""
fused AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, dense DESC, chunk_id) AS rank FROM (
  SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / ({P.RRF_K} + rank)), 9) AS rrf, max(dense) AS dense, count(*) AS n_lists FROM (
   SELECT question_id, chunk_id, rank, cosine AS dense FROM nearest WHERE rank <= {P.RRF_CANDIDATES}
   UNION ALL SELECT question_id, chunk_id, rank, 0.0 FROM bm25 UNION ALL SELECT question_id, chunk_id, rank, 0.0 FROM structural)
  GROUP BY question_id, chunk_id)) WHERE rank <= 8
)
"""
ASK = [QUESTIONS, PARSED, MODEL, HINTED]
INDEX = [CORPUS, SEGMENTS, CHUNKS, CHUNK_TOKENS]
SMART = INDEX + ASK + [VECTORS, ASKED, NEAREST, FILTERS, CANDIDATES]


def stmt(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def typed(ctes: list[str], doc_type: str) -> list[str]:
    """The statements over the chunks of one type; BM25 ranks all chunks and drops other types after its top rows."""
    out = []
    for cte in ctes:
        if cte is CHUNKS:
            out += [cte.replace("\nchunks AS (", "\nevery_chunk AS ("), f"chunks AS (SELECT * FROM every_chunk WHERE doc_type = '{doc_type}')"]
        elif cte is BM25:
            out += [CHUNK_TOKENS.replace("chunk_tokens AS", "every_token AS").replace("FROM chunks", "FROM every_chunk")]
            out += [cte.replace("chunk_tokens", "every_token").replace("bm25 AS MATERIALIZED", "every_bm25 AS MATERIALIZED")]
            out += ["bm25 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM every_bm25 WHERE chunk_id IN (SELECT chunk_id FROM chunks))"]
        else:
            out.append(cte)
    return out
