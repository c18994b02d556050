"""Shared SQL: the derived tables as common table expressions for DuckDB."""

from __future__ import annotations

from docspark import profiles as P

PAGE_CHARS = 3000


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


WS = q(P.WHITESPACE)


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


_LINE = """
CASE (i - 1 + doc_id) % 11
 WHEN 1 THEN '① ' || l || ' 연구활동비를 사용'
 WHEN 2 THEN l || ' 종전 혁신법에서는 비목'
 WHEN 3 THEN '제' || i || '조(' || left(l, 12) || ')' || chr(10) || l
 WHEN 5 THEN ' 제' || i || '조의' || (doc_id % 3 + 2) || ' (' || left(l, 12) || ') ' || l
 WHEN 6 THEN '    제' || i || '조(' || left(l, 12) || ')' || chr(10) || l
 WHEN 7 THEN chr(10) || '■ 별표 ' || i || chr(10) || l
 WHEN 8 THEN '부 칙' || chr(10) || i || '. ' || l
 WHEN 9 THEN l || ' 「국가연구개발혁신법」 제' || i || '조제2항에 따라'
 WHEN 10 THEN '가) ' || l
 ELSE l END
"""

CORPUS = f"""
corpus AS (
 SELECT doc_id, doc_name, doc_type, text,
  CASE WHEN source IN ('src3', 'src9') AND lang = 'en' THEN '[별표 ' || (doc_id % 9 + 1) || '] ' || doc_name || '_' || doc_id || '.hwp'
       ELSE doc_name || '_' || doc_id || '.pdf' END AS source_file
 FROM (SELECT doc_id, source, lang,
   CASE lang WHEN 'en' THEN '혁신법 시행령 ' WHEN 'fr' THEN '혁신법 시행규칙 ' WHEN 'de' THEN '연구개발 매뉴얼 ' ELSE '혁신법 법률 ' END || source AS doc_name,
   CASE lang WHEN 'en' THEN '시행령' WHEN 'fr' THEN '시행규칙' WHEN 'de' THEN '매뉴얼' ELSE 'FAQ' END AS doc_type,
   array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {_LINE}), chr(10)) AS text
  FROM documents)
),
pages_k AS (
 SELECT *, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_num) - length(text) - 1)::BIGINT AS start
 FROM (SELECT doc_id, doc_name, doc_type, source_file, p + 1 AS page_num, substr(text, p * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS text
       FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + {PAGE_CHARS - 1}) // {PAGE_CHARS}))) AS p FROM corpus))
 WHERE length({strip('text')}) > 0
),
full_k AS (
 SELECT doc_id, any_value(doc_name) AS doc_name, any_value(doc_type) AS doc_type, any_value(source_file) AS source_file,
  string_agg(text, chr(10) ORDER BY page_num) AS full_text, list(start ORDER BY page_num) AS starts, list(page_num ORDER BY page_num) AS nums
 FROM pages_k GROUP BY doc_id
)
"""


def page_at(offset: str) -> str:
    """As-of page of an offset, from the lists ``starts`` and ``nums``."""
    return f"coalesce(nums[len(list_filter(starts, lambda s: s <= {offset}))], 1)"


def packed(parts: str, limit: int = P.MAX_CHUNK_LEN) -> str:
    """Greedy packing of a list of strings, as one string separated by chr(1); NULL for an empty list."""
    keep = f"list_filter({parts}, lambda s: length({strip('s')}) > 0)"
    return (
        f"CASE WHEN len({keep}) > 0 THEN list_reduce({keep}, lambda a, p: a || CASE WHEN "
        f"length(string_split(a, chr(1))[-1]) + 1 + length(p) <= {limit} THEN chr(10) ELSE chr(1) END || p) END"
    )


def cut_lines(text: str, limit: int = P.MAX_CHUNK_LEN) -> str:
    return (
        f"flatten(list_transform(string_split({text}, chr(10)), lambda n: CASE WHEN length(n) <= {limit} THEN [n] ELSE "
        f"list_transform(range(0, length(n), {limit}), lambda b: substr(n, b + 1, {limit})) END))"
    )


def cut_items(text: str, markers) -> str:
    pattern = r"(?:\n\s*)?(\n[ \t\r\f]*(?:" + "|".join(markers) + "))"
    return f"string_split(regexp_replace({text}, {q(pattern)}, chr(1) || '\\1', 'g'), chr(1))"


_HEADER = (
    r"(?m)(^[ \t]{0,3}제\d+조(?:의\d+)?(?:\s*\([^)]*\))?|^[\s■◎●]*별표\s*\d+|^[\s■◎●]*별표|^\s*부\s*칙)"
    r"([ \t\r\f\v]*$|\s*\()"
)
_FAQ = r"((?:Q|질문|문)\s*[\.\)：:]?\s*\d*\s*|○\s*질의|○\s*답변)"
_FIRST = (
    f"{strip('string_split_regex(' + strip('after') + ', ' + q(P.LINE_BREAKS) + ')[1]')}"
)
_APPENDIX_TITLE = (
    "coalesce(list_transform(list_filter(list_filter(list_transform(string_split_regex(full_text, "
    + q(P.LINE_BREAKS) + f"), lambda s: {strip('s')}), lambda s: s <> '')[1:5], lambda s: NOT contains(s, '[별표') AND NOT "
    + f"regexp_matches(s, {q(P.APPENDIX_FILE_PATTERN)})), lambda s: left(coalesce(nullif({strip('regexp_extract(s, ' + q(r'^([^()]{2,80})' + chr(92) + 's*' + chr(92) + '(') + ', 1)')}, ''), s), 80))[1], '')"
)

SEGMENTS = f"""
routed AS (
 SELECT *, CASE WHEN regexp_matches(source_file, {q(P.APPENDIX_FILE_PATTERN)}) THEN 'appendix'
   WHEN doc_type IN {in_list(P.MANUAL_DOC_TYPES)} OR {any_of('source_file', P.MANUAL_NAME_TOKENS)} THEN 'manual'
   WHEN upper(doc_type) = 'FAQ' AND regexp_matches(full_text, {q('(?i)' + _FAQ)}) THEN 'faq' ELSE 'articles' END AS route
 FROM full_k
),
cuts AS (
 SELECT *, CASE WHEN route = 'faq' THEN regexp_replace(full_text, {q(_FAQ)}, chr(1) || '\\1' || chr(2), 'gi')
   ELSE regexp_replace(full_text, {q(_HEADER)}, chr(1) || '\\1' || chr(2) || '\\2', 'g') END AS marked
 FROM routed WHERE route IN ('faq', 'articles')
),
cut_rows AS (
 SELECT *, (sum(length(seg)) OVER w - length(seg))::BIGINT AS start, sum(length(seg)) OVER w ::BIGINT AS "end"
 FROM (SELECT doc_id, doc_name, doc_type, source_file, route, full_text, starts, nums, n, len(string_split(marked, chr(1))) - 1 AS n_cuts,
   string_split(marked, chr(1))[n] AS raw, replace(string_split(marked, chr(1))[n], chr(2), '') AS seg
  FROM (SELECT *, unnest(range(1, len(string_split(marked, chr(1))) + 1)) AS n FROM cuts))
 WINDOW w AS (PARTITION BY doc_id ORDER BY n)
),
cut_segs AS (
 SELECT *, substr(full_text, start + length(split_part(raw, chr(2), 1)) + 1, 100) AS after FROM cut_rows
),
segments AS (
 SELECT doc_id, doc_name, doc_type, source_file, route, starts, nums, {strip('seg')} AS seg_text,
  CASE WHEN route = 'faq' THEN 'FAQ-' || (n - 1) WHEN n_cuts = 0 THEN '' WHEN n = 1 THEN '서문'
   ELSE {strip("regexp_replace(split_part(raw, chr(2), 1), '^[" + chr(92) + "s■◎●]+', '')")} END AS label,
  CASE WHEN route = 'faq' OR n = 1 THEN '' WHEN regexp_extract({_FIRST}, {q(r'\(([^)]{2,30})\)')}, 1) <> '' THEN regexp_extract({_FIRST}, {q(r'\(([^)]{2,30})\)')}, 1)
   WHEN length({_FIRST}) <= 30 THEN {_FIRST} ELSE '' END AS title,
  CASE WHEN n = 1 THEN coalesce(nums[1], 1) ELSE {page_at('start')} END AS page, start, "end",
  CASE WHEN n_cuts = 0 THEN 0 ELSE row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 END AS seg_no
 FROM cut_segs
 WHERE n > 1 OR n_cuts = 0 OR (route = 'articles' AND length({strip('seg')}) >= {P.MIN_CHUNK_LEN})
 UNION ALL
 SELECT doc_id, doc_name, doc_type, source_file, route, starts, nums, {strip('full_text')},
  '별표 ' || regexp_extract(source_file, {q(P.APPENDIX_FILE_PATTERN)}, 1), {_APPENDIX_TITLE}, coalesce(nums[1], 1), 0, length(full_text), 0
 FROM routed WHERE route = 'appendix'
 UNION ALL
 SELECT doc_id, p.doc_name, p.doc_type, p.source_file, 'manual', starts, nums, {strip('p.text')}, 'p.' || page_num, '', page_num, p.start,
  p.start + length(p.text), row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1
 FROM pages_k p JOIN (SELECT doc_id, starts, nums FROM routed WHERE route = 'manual') USING (doc_id) WHERE length({strip('p.text')}) >= {P.MIN_CHUNK_LEN}
)
"""


def _long(markers) -> str:
    inner = packed(cut_lines("t"))
    pieces = (
        f"flatten(list_transform(list_filter({cut_items('seg_text', markers)}, lambda s: length({strip('s')}) > 0), "
        f"lambda t: CASE WHEN length(t) <= {P.MAX_CHUNK_LEN} THEN [t] ELSE string_split({inner}, chr(1)) END))"
    )
    return f"(SELECT string_split({packed('x')}, chr(1)) FROM (SELECT {pieces} AS x))"


CHUNKS = f"""
part_rows AS (
 SELECT * EXCLUDE (parts), len(parts) AS n_parts, unnest(range(0, len(parts))) AS part_no, unnest(parts) AS text,
  coalesce(list_sum(list_transform(parts, lambda s: length(s))), 0)::BIGINT AS total
 FROM (SELECT * EXCLUDE (parts), list_transform(parts, lambda s: {strip('s')}) AS parts FROM (
  SELECT *, CASE WHEN length(seg_text) <= {P.MAX_CHUNK_LEN} THEN [seg_text]
   WHEN route = 'appendix' THEN {_long(P.APPENDIX_ITEM_MARKERS)} ELSE {_long(P.ITEM_MARKERS)} END AS parts
  FROM segments WHERE length(seg_text) >= {P.MIN_CHUNK_LEN}))
),
parts AS (
 SELECT *, (sum(length(text)) OVER (PARTITION BY doc_id, seg_no ORDER BY part_no) - length(text))::BIGINT AS before FROM part_rows
),
chunks AS (
 SELECT sha256(source_file || '#' || seg_no || '#' || part_no) AS chunk_id, doc_name, doc_type, label AS parent_label,
  CASE WHEN n_parts > 1 THEN label || ' (part ' || (part_no + 1) || '/' || n_parts || ')' ELSE label END AS article_no,
  title AS article_title,
  (CASE WHEN n_parts > 1 AND "end" > start THEN {page_at('start + floor(before / greatest(total, 1)::DOUBLE * ("end" - start))::BIGINT')} ELSE page END)::BIGINT AS page,
  '' AS effective_date, '' AS revised_date, true AS is_current, source_file, text
 FROM parts WHERE length(text) >= {P.MIN_CHUNK_LEN}
)
"""


def with_corpus(body: str, *more: str) -> str:
    return "WITH " + ", ".join([CORPUS, *more]) + body


def with_segments(body: str, *more: str) -> str:
    return "WITH " + ", ".join([CORPUS, SEGMENTS, *more]) + body


def with_chunks(body: str, *more: str) -> str:
    return "WITH " + ", ".join([CORPUS, SEGMENTS, CHUNKS, *more]) + body
