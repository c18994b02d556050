"""Registered queries: evidence, prompts, answers, cache and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.operators import answers as N
from docspark.operators import evaluate as E
from docspark.operators import evidence as V
from docspark.operators import quality as Z
from docspark.operators import retrieve as R
from docspark.operators import usage as U
from docspark.plans import derived as D
from docspark.plans import lookups as K
from docspark.plans import reports as G
from docspark.plans.oracle import search as S
from docspark.plans.oracle.base import in_list, q, strip, with_chunks
from docspark.plans.registry import query
from docspark.plans.retrieval import smart_hits

# --- cache -------------------------------------------------------------------------------------------------
REQUESTS = """
requests AS (SELECT *, question_id % 2 = 0 AS use_mcp, question_id % 3 = 0 AS use_web,
 sha256('q=' || trim(question) || '|dt=|mcp=' || (question_id % 2 = 0)::INT || '|web=' || (question_id % 3 = 0)::INT || '|model=base|kind=' || kind || '|doc=' || doc_name_hint) AS cache_key FROM hinted),
cache AS (SELECT cache_key, '가능' AS verdict, question AS summary, TIMESTAMP '2024-01-01' + to_days(question_id::INT) AS saved_at,
 CASE WHEN toxic = 1 THEN '1.3.4' ELSE '1.4.0' END AS chunker_version FROM requests JOIN labels ON question_id = doc_id WHERE quality = 1)
"""


def requests(spark, sf):
    rows = D.hinted(spark, sf).withColumns({
        "doc_type_filter": F.lit(""), "use_mcp": F.col("question_id") % 2 == 0, "use_web": F.col("question_id") % 3 == 0, "model": F.lit("base"),
    })
    return rows.withColumn("cache_key", U.cache_key())


def cache(spark, sf):
    rated = D.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("question_id"), "toxic")
    day = F.timestamp_seconds(F.lit(1704067200) + F.col("question_id") * 86400)
    version = F.when(F.col("toxic") == 1, "1.3.4").otherwise(P.CHUNKER_VERSION)
    return requests(spark, sf).join(rated, "question_id").select(
        "cache_key", F.lit("가능").alias("verdict"), F.col("question").alias("summary"), day.alias("saved_at"), version.alias("chunker_version")
    )


CACHED = [*S.ASK, REQUESTS]


@query("cache_key", S.stmt("SELECT question_id, cache_key FROM requests", *CACHED))
def cache_key(spark, sf):
    return requests(spark, sf).select("question_id", "cache_key")


@query("cache_lookup", S.stmt("SELECT question_id, c.cache_key IS NOT NULL AS hit, verdict, saved_at FROM requests r LEFT JOIN cache c USING (cache_key)", *CACHED))
def cache_lookup(spark, sf):
    return U.cache_lookup(requests(spark, sf), cache(spark, sf)).select("question_id", "hit", "verdict", "saved_at")


_VERDICT = "CASE question_id % 5 WHEN 0 THEN '가능' WHEN 1 THEN '불가' WHEN 2 THEN '조건부 가능' WHEN 3 THEN '판단불가' ELSE ' ' END"


def _verdict():
    i = F.col("question_id") % 5
    return F.when(i == 0, "가능").when(i == 1, "불가").when(i == 2, "조건부 가능").when(i == 3, "판단불가").otherwise(" ")


@query("cache_upsert", S.stmt(f"""SELECT cache_key, arg_max(verdict, saved_at) AS verdict, max(saved_at) AS saved_at FROM (SELECT cache_key, verdict, saved_at FROM cache
 UNION ALL SELECT cache_key, {_VERDICT}, TIMESTAMP '2024-02-01' FROM requests WHERE question_id % 5 < 3) GROUP BY 1""", *CACHED))
def cache_upsert(spark, sf):
    fresh = requests(spark, sf).select(
        "cache_key", _verdict().alias("verdict"), F.col("question").alias("summary"), F.lit("2024-02-01").cast("timestamp").alias("saved_at"),
        F.lit(P.CHUNKER_VERSION).alias("chunker_version"),
    )
    return U.cache_upsert(cache(spark, sf), fresh).select("cache_key", "verdict", "saved_at")


@query("cache_invalidate", S.stmt("SELECT cache_key, (SELECT count(*) FROM cache WHERE chunker_version <> '1.4.0') AS n_cleared FROM cache WHERE chunker_version = '1.4.0'", *CACHED))
def cache_invalidate(spark, sf):
    kept, cleared = U.cache_invalidate(cache(spark, sf), P.CHUNKER_VERSION)
    return kept.select("cache_key", cleared.scalar().alias("n_cleared"))


ROUTED = """
routes AS (SELECT r.*, CASE WHEN kind = 'chat' AND chat_response <> '' THEN 'chat' WHEN c.cache_key IS NOT NULL THEN 'cache' WHEN kind = 'page_lookup' AND len(target_pages) > 0 THEN 'page_lookup' ELSE 'search' END AS route
 FROM requests r LEFT JOIN cache c USING (cache_key))
"""


def routes(spark, sf):
    return V.answer_routes(requests(spark, sf), cache(spark, sf))


# --- evidence ----------------------------------------------------------------------------------------------
_BASES = f"list_filter(list_transform(list(doc_name ORDER BY slot), lambda d: {strip('string_split_regex(d, ' + q(chr(91) + chr(92) + '(' + chr(92) + '[<]') + ')[1]')}), lambda d: d <> '')"
_NAMED = f"list_filter(list_transform(regexp_extract_all(question, {q(P.LAW_NAME)}), lambda m: regexp_replace(m, '\\s+', '', 'g')), lambda m: m NOT IN {in_list(P.LAW_WORDS_ALONE)})"
LAWS = f"""
law_lists AS (SELECT question_id, question, {S.distinct("list_concat(named, bases)")} AS names FROM (SELECT question_id, question, {_NAMED} AS named, coalesce(bases, []) AS bases FROM questions
 LEFT JOIN (SELECT question_id, {_BASES} AS bases FROM smart GROUP BY 1) USING (question_id))),
laws AS (SELECT question_id, question, CASE WHEN len(names) > 0 THEN names[1:{P.LAWS_PER_QUESTION}] ELSE [question] END AS names FROM law_lists),
law_rows AS (SELECT question_id, pos AS rank, names[pos] AS query, CASE WHEN question_id % 3 = 0 THEN '[NOT_FOUND] ' ELSE names[pos] || ': ' END || text AS text
 FROM (SELECT *, unnest(range(1, len(names) + 1)) AS pos FROM laws) JOIN benchmark ON question_id = item_id),
law_evidence AS (SELECT question_id, rank, '{P.LAW_PREFIX}' || query AS doc_name, '{P.LAW_TYPE}' AS doc_type, '{P.LAW_ARTICLE}' AS article_no, '' AS article_title, 0::BIGINT AS page, left(text, {P.LAW_CHARS}) AS text
 FROM law_rows WHERE NOT contains(text, '{P.NOT_FOUND}'))
"""
_BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '(?is)^.*</head>', ' '), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
WEB = f"""
web_rows AS (SELECT page_id AS question_id, url, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, trim({_BODY}) AS body FROM pages),
web_evidence AS (SELECT question_id, 1 AS rank, CASE WHEN title <> '' THEN title ELSE '{P.WEB_DEFAULT_NAME}' END AS doc_name, '{P.WEB_TYPE}' AS doc_type, url AS article_no, '' AS article_title, 0::BIGINT AS page,
 left({strip("title || chr(10) || body")}, {P.WEB_CHARS}) AS text FROM web_rows WHERE length({strip("title || chr(10) || body")}) >= {P.EVIDENCE_MIN_CHARS})
"""


def law_queries(spark, sf):
    hits = smart_hits(spark, sf).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("slot", "doc_name"))).alias("h"))
    rows = D.questions(spark, sf).join(hits, "question_id", "left")
    names = F.coalesce(F.transform("h", lambda h: h["doc_name"]), F.array().cast("array<string>"))
    return rows.select("question_id", "question", V.law_names(F.col("question"), names, P.LAWS_PER_QUESTION).alias("names"))


def fetched_laws(spark, sf):
    rows = law_queries(spark, sf).select("question_id", F.posexplode("names").alias("pos", "query"))
    texts = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("body"))
    head = F.when(F.col("question_id") % 3 == 0, P.NOT_FOUND + " ").otherwise(F.concat("query", F.lit(": ")))
    return rows.join(texts, "question_id").select("question_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "query", F.concat(head, "body").alias("text"))


def web_results(spark, sf):
    pages = D.table(spark, sf, "pages")
    return pages.select(F.col("page_id").alias("question_id"), F.lit(1).cast("bigint").alias("rank"), "url", *[c.alias(n) for n, c in V.page_text(F.col("html")).items()])


@query("law_names", S.stmt(f"SELECT question_id, array_to_string({S.distinct('list_concat(' + _NAMED + ', [])')}, '|') AS named FROM questions", S.QUESTIONS))
def law_names(spark, sf):
    none = F.array().cast("array<string>")
    named = V.law_names(F.col("question"), none)
    asked = F.size(named) == 1
    return D.questions(spark, sf).select("question_id", F.when(asked & (F.get(named, F.lit(0)) == F.col("question")), "").otherwise(F.array_join(named, "|")).alias("named"))


@query("cap_external_queries", S.stmt("SELECT question_id, array_to_string(names, '|') AS names FROM laws", *S.SMART, LAWS))
def cap_external_queries(spark, sf):
    return law_queries(spark, sf).select("question_id", F.array_join("names", "|").alias("names"))


_EV = "doc_name, doc_type, article_no, article_title, page, text"


@query("external_evidence_rows", S.stmt(f"SELECT question_id, rank, {_EV} FROM law_evidence UNION ALL SELECT question_id, rank, {_EV} FROM web_evidence", *S.SMART, LAWS, WEB))
def external_evidence_rows(spark, sf):
    keep = ["question_id", "rank"]
    return V.law_evidence(fetched_laws(spark, sf), keep).unionByName(V.web_evidence(web_results(spark, sf), keep))


@query("statute_text", """SELECT doc_id, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l, i: list_filter([
 CASE WHEN l <> '' THEN trim(CASE WHEN i > 1 THEN '제' || (i - 1) || '조' || CASE WHEN i % 2 = 0 THEN '(' || lang || ')' ELSE '' END ELSE '' END || ' ' || l) END,
 CASE WHEN source <> '' THEN '  1항: ' || source END, CASE WHEN i % 3 = 0 THEN '    2호: ' || lang END], lambda x: x IS NOT NULL))), chr(10)) AS statute FROM documents""")
def statute_text(spark, sf):
    """Every line of a document as an article with one paragraph and, for every third, an item."""
    d = D.spread(D.table(spark, sf, "documents"))

    def article(line, i):
        item = F.when(i % 3 == 2, F.col("lang")).otherwise("")
        return F.struct(
            i.cast("string").alias("no"), F.when(i % 2 == 1, F.col("lang")).otherwise("").alias("title"), F.trim(line).alias("content"),
            F.array(F.struct(
                F.lit("1").alias("no"), F.col("source").alias("content"), F.array(F.struct(F.lit("2").alias("no"), item.alias("content"))).alias("items"),
            )).alias("paragraphs"),
        )

    return d.select("doc_id", V.statute_text(F.transform(F.split("text", "\n"), article)).alias("statute"))


EVIDENCE = f"""
evidence AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY part, rank) AS place, {_EV} FROM (
 SELECT question_id, 0 AS part, slot AS rank, c.doc_name, doc_type, article_no, article_title, page, text FROM smart JOIN routes USING (question_id) JOIN (SELECT chunk_id, doc_name, doc_type AS dt, article_no, article_title, page, text FROM chunks) c USING (chunk_id), LATERAL (SELECT dt AS doc_type) WHERE route = 'search'
 UNION ALL SELECT question_id, 1, rank, {_EV} FROM law_evidence JOIN (SELECT question_id FROM routes WHERE route = 'search') USING (question_id)
 UNION ALL SELECT question_id, 2, rank, {_EV} FROM web_evidence JOIN (SELECT question_id FROM routes WHERE route = 'search') USING (question_id)
 UNION ALL SELECT question_id, 3, 1, doc_name_hint, '', '', '', coalesce(target_pages[1], 0), {q(P.PLACEHOLDER)} FROM routes WHERE kind IN ('page_lookup', 'article_lookup') AND route <> 'search')),
contexts AS (SELECT question_id, count(*) AS n_chunks, string_agg('[근거 ' || place || ']' || chr(10) || '문서명: ' || doc_name || chr(10) || '문서유형: ' || doc_type || chr(10) || '조문번호: ' || article_no || chr(10) || '조문제목: ' || article_title || chr(10) || '페이지: ' || page || chr(10) || '내용:' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context FROM evidence GROUP BY 1)
"""
EVID = [*S.SMART, REQUESTS, ROUTED, LAWS, WEB, EVIDENCE]


def evidence(spark, sf):
    def build():
        routed = routes(spark, sf)
        searched = routed.filter("route = 'search'").select("question_id")
        hits = smart_hits(spark, sf).join(searched, "question_id", "left_semi").select("question_id", F.col("slot").alias("rank"), "chunk_id", "score")
        retrieved = R.project_evidence(R.project_hits(hits, D.chunks(spark, sf)))
        keep = ["question_id", "rank"]
        law = V.law_evidence(fetched_laws(spark, sf), keep).join(searched, "question_id", "left_semi")
        web = V.web_evidence(web_results(spark, sf), keep).join(searched, "question_id", "left_semi")
        return V.evidence_union(routed, retrieved, law, web)

    return D.materialize(spark, "evidence", sf, build)


@query("evidence_union", S.stmt(f"SELECT question_id, place, {_EV} FROM evidence", *EVID))
def evidence_union(spark, sf):
    return evidence(spark, sf).select("question_id", "place", *V.COLUMNS)


@query("build_context", S.stmt("SELECT question_id, n_chunks, context FROM contexts", *EVID))
def build_context(spark, sf):
    return V.build_context(evidence(spark, sf))


@query("context_stats", S.stmt(f"SELECT question_id, n_chunks, length(context) AS n_chars, length(context) AS n_tokens, {P.TOKEN_LIMIT}::BIGINT AS limit_tokens, round(length(context) / {P.TOKEN_LIMIT} * 100, 1) AS limit_pct FROM contexts", *EVID))
def context_stats(spark, sf):
    return V.context_stats(V.build_context(evidence(spark, sf)))


@query("answer_routing", S.stmt("""SELECT question_id, route, coalesce(n_chunks, 0) AS n_evidence, route IN ('search', 'page_lookup') AND n_chunks IS NULL AS abstains,
 CASE WHEN route = 'chat' THEN chat_response WHEN route IN ('search', 'page_lookup') AND n_chunks IS NULL THEN '판단불가' ELSE '' END AS direct FROM routes LEFT JOIN contexts USING (question_id)""", *EVID))
def answer_routing(spark, sf):
    counts = evidence(spark, sf).groupBy("question_id").agg(F.count("*").alias("n"))
    rows = routes(spark, sf).join(counts, "question_id", "left")
    abstains = F.col("route").isin("search", "page_lookup") & F.col("n").isNull()
    return rows.select(
        "question_id", "route", F.coalesce("n", F.lit(0)).alias("n_evidence"), abstains.alias("abstains"),
        F.when(F.col("route") == "chat", F.col("chat_response")).when(abstains, P.ABSTAIN).otherwise("").alias("direct"),
    )


# --- conversations -----------------------------------------------------------------------------------------
def _history_sql(shape):
    back, user, assistant, mark = shape
    text = strip("text")
    cut = f"CASE WHEN length({text}) > lim THEN left({text}, lim) || '{mark}' ELSE {text} END"
    placed = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth FROM conversations"
    return f"""SELECT a.conv_id, a.turn, coalesce(string_agg(CASE WHEN b.role = 'user' THEN {q(P.USER_TURN)} ELSE {q(P.ASSISTANT_TURN)} END || b.content, chr(10) || chr(10) ORDER BY b.nth), '') AS history
 FROM ({placed}) a LEFT JOIN (SELECT conv_id, nth, role, {cut} AS content FROM (SELECT *, CASE WHEN role = 'user' THEN {user} ELSE {assistant} END AS lim FROM ({placed})) WHERE role IN ('user', 'assistant') AND {text} <> '') b
 ON a.conv_id = b.conv_id AND b.nth < a.nth AND b.nth >= a.nth - {back} GROUP BY a.conv_id, a.turn, a.nth"""


for _name, _shape in (("history_window", P.HISTORY_PROMPT), ("history_analyzer", P.HISTORY_ANALYZER), ("history_view", P.HISTORY_VIEW)):
    query(_name, _history_sql(_shape))(lambda spark, sf, s=_shape: V.history(D.table(spark, sf, "conversations"), s))


_HINT_SQL = (
    "CASE WHEN kind IN ('page_lookup', 'article_lookup') THEN replace(" + q(P.LOOKUP_HINT) + ", '{kind}', kind) WHEN kind = 'comparison' THEN " + q(P.COMPARISON_HINT) + " ELSE '' END"
)


@query("user_prompt", S.stmt(f"""SELECT question_id, {_HINT_SQL} || CASE WHEN coalesce(history, '') <> '' THEN {q(P.HISTORY_HEAD)} || history || chr(10) || chr(10) ELSE '' END
 || '[검색된 근거]' || chr(10) || coalesce(blocks, '{P.NO_EVIDENCE}') || chr(10) || chr(10) || '[질문]' || chr(10) || question AS prompt
 FROM routes LEFT JOIN (SELECT question_id, string_agg('[근거 ' || place || ']' || chr(10) || '문서명: ' || doc_name || chr(10) || '조문: ' || article_no || chr(10) || '페이지: ' || page || chr(10) || '내용:' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS blocks FROM evidence GROUP BY 1) USING (question_id)
 LEFT JOIN (SELECT conv_id AS question_id, history FROM ({_history_sql(P.HISTORY_PROMPT)}) QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)) USING (question_id)""", *EVID))
def user_prompt(spark, sf):
    """The question of a conversation follows its last turn."""
    turns = D.table(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    past = V.history(turns, P.HISTORY_PROMPT).join(last, ["conv_id", "turn"])
    return V.user_prompts(routes(spark, sf), evidence(spark, sf), past.select(F.col("conv_id").alias("question_id"), "history"))


# --- answers -----------------------------------------------------------------------------------------------
@query("parse_answers", S.stmt("""SELECT question_id, CASE question_id % 6 WHEN 2 THEN 'no_object' WHEN 3 THEN 'bad_verdict' WHEN 5 THEN 'no_object' ELSE CASE WHEN question_id % 6 = 4 AND s.chunk_id IS NULL THEN 'no_citation' END END AS error,
 CASE question_id % 6 WHEN 0 THEN '가능' WHEN 1 THEN '불가' WHEN 3 THEN '아마도' WHEN 4 THEN '판단불가' END AS verdict, CASE WHEN question_id % 6 NOT IN (2, 5) THEN question || ' {"}' END AS summary,
 CASE WHEN question_id % 6 IN (0, 1, 3) THEN '인용' WHEN question_id % 6 = 4 THEN left(c.text, 50) ELSE left(c.text, 50) END AS quote FROM questions LEFT JOIN (SELECT * FROM smart WHERE slot = 1) s USING (question_id) LEFT JOIN chunks c USING (chunk_id)""", *S.SMART))
def parse_answers(spark, sf):
    """Responses in six shapes: fenced, bare with a tail, without an object, unknown verdict, without citations, cut off."""
    i = F.col("question_id") % 6
    citation = F.struct(F.lit("법").alias("document_name"), F.lit("제1조").alias("article_no"), F.lit(1).alias("page"), F.lit("인용").alias("quote"))
    none = F.array().cast("array<string>")

    def body(verdict, cites):
        return F.to_json(F.struct(
            F.lit(verdict).alias("verdict"), F.concat("question", F.lit(' {"}')).alias("summary"), cites.alias("citations"), F.lit(False).alias("follow_up_needed"),
            none.alias("follow_up_questions"), none.alias("risk_notes"),
        ))

    cited, empty = F.array(citation), F.slice(F.array(citation), 1, 0)
    response = (
        F.when(i == 0, F.concat(F.lit("설명\n```json\n"), body("가능", cited), F.lit("\n```\n끝 {}")))
        .when(i == 1, F.concat(F.lit("답: "), body("불가", cited), F.lit(" 이상 {x}"))).when(i == 2, "근거가 없습니다")
        .when(i == 3, body("아마도", cited)).when(i == 4, body("판단불가", empty)).otherwise('{"verdict": "가능", "summary": "')
    )
    hits = smart_hits(spark, sf).filter("slot = 1").select("question_id", "chunk_id")
    first = hits.join(D.chunks(spark, sf).select("chunk_id", "doc_name", "article_no", "page", "text"), "chunk_id")
    out = N.parse_answers(D.questions(spark, sf).select("question_id", response.alias("response")), first)
    return out.select("question_id", "error", "verdict", "summary", F.get("citations", F.lit(0))["quote"].alias("quote"))


# --- evaluation --------------------------------------------------------------------------------------------
CASES = """
cases AS (SELECT question_id AS case_id, question_id % 8 + 1 AS category, question, 5 AS top_k FROM questions),
hits_a AS (SELECT question_id AS case_id, slot AS rank, c.doc_name, article_no, page, text, score FROM smart JOIN (SELECT chunk_id, doc_name, article_no, page, text FROM chunks) c USING (chunk_id)),
hits_b AS (SELECT question_id AS case_id, rank, doc_name, article_no, page, text, rrf AS score FROM fused JOIN chunks USING (chunk_id))
"""


def _ok_sql(hits):
    return f"""SELECT case_id, rank, CASE case_id % 4 WHEN 0 THEN starts_with(article_no, '제') WHEN 1 THEN (contains(text, '연구활동비') AND contains(text, '비목') AND contains(doc_name, '시행령')) OR contains(article_no, '조의')
 WHEN 2 THEN page = 1 AND score < 1.1 ELSE starts_with(article_no, '별표7') OR starts_with(article_no, '별표 7') OR starts_with(article_no, '별표  7') OR contains(text, '종전') OR contains(text, '가)') END AS ok FROM {hits}"""


RESULTS = f"""
ok_a AS ({_ok_sql('hits_a')}), ok_b AS ({_ok_sql('hits_b')}),
pass_a AS (SELECT case_id, category, coalesce(bool_or(ok), false) AS passed FROM cases LEFT JOIN (SELECT * FROM ok_a WHERE rank <= 5) USING (case_id) GROUP BY 1, 2),
pass_b AS (SELECT case_id, category, coalesce(bool_or(ok), false) AS passed FROM cases LEFT JOIN (SELECT * FROM ok_b WHERE rank <= 5) USING (case_id) GROUP BY 1, 2),
cats AS (SELECT category, count(*) FILTER (WHERE passed) AS n_pass, count(*) AS n_total, count(*) FILTER (WHERE passed) / count(*) AS r FROM pass_a GROUP BY 1),
cat_rows AS (SELECT category, n_pass, n_total, round(r, 4) AS rate, [{', '.join(f'{t}::DOUBLE' for t in P.EVAL_THRESHOLDS)}][category] AS threshold, r >= [{', '.join(f'{t}::DOUBLE' for t in P.EVAL_THRESHOLDS)}][category] AS ok FROM cats),
ab AS (SELECT case_id, a.passed AS a_passed, b.passed AS b_passed, value AS a_ms, value / 2 AS b_ms FROM pass_a a JOIN pass_b b USING (case_id)
 LEFT JOIN (SELECT event_id % (SELECT count(*) FROM questions) AS case_id, avg(value) AS value FROM events GROUP BY 1) USING (case_id))
"""
EVAL = [*S.SMART, S.STRUCTURAL, S.BM25, S.FUSED, CASES, RESULTS]


def cases(spark, sf):
    return D.questions(spark, sf).select(
        F.col("question_id").alias("case_id"), (F.col("question_id") % 8 + 1).alias("category"), "question", F.lit(5).cast("bigint").alias("top_k")
    )


def predicates(spark, sf):
    """Predicates per case: (group, kind, argument) rows by the case's turn."""
    sets = {
        0: [(0, "label_prefix", "제")],
        1: [(0, "text_all", "연구활동비|비목"), (0, "doc_contains", "시행령"), (1, "label_contains", "조의")],
        2: [(0, "page_equals", "1"), (0, "score_below", "1.1")],
        3: [(0, "appendix", "7"), (1, "text_any", "종전|가)")],
    }
    rows = None
    for turn, items in sets.items():
        value = F.array(*[F.struct(F.lit(g).alias("group_id"), F.lit(k).alias("kind"), F.lit(a).alias("arg")) for g, k, a in items])
        rows = value if rows is None else F.when(F.col("case_id") % 4 == turn, value).otherwise(rows)
    return cases(spark, sf).select("case_id", F.inline(rows))


def hits_of(spark, sf, name):
    if name == "smart":
        hits = smart_hits(spark, sf).select(F.col("question_id").alias("case_id"), F.col("slot").cast("bigint").alias("rank"), "chunk_id", "score")
    else:
        def build():
            return R.hybrid_search(D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf), D.bm25_index(spark, sf), D.bm25_terms(spark, sf))

        hits = D.materialize(spark, "hybrid-hits", sf, build).select(
            F.col("question_id").alias("case_id"), F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.col("rrf").alias("score")
        )
    return hits.join(D.chunks(spark, sf).select("chunk_id", "doc_name", "article_no", F.col("page").cast("bigint").alias("page"), "text"), "chunk_id")


def _passed(spark, sf, name):
    return E.case_results(cases(spark, sf), E.predicate_results(hits_of(spark, sf, name), predicates(spark, sf)))


@query("eval_predicates", S.stmt("SELECT case_id, rank, ok FROM ok_a", *EVAL))
def eval_predicates(spark, sf):
    return E.predicate_results(hits_of(spark, sf, "smart"), predicates(spark, sf))


@query("eval_cases", S.stmt("SELECT case_id, category, passed FROM pass_a", *EVAL))
def eval_cases(spark, sf):
    return _passed(spark, sf, "smart")


@query("eval_categories", S.stmt("SELECT * FROM cat_rows", *EVAL))
def eval_categories(spark, sf):
    return E.category_results(_passed(spark, sf, "smart"))


@query("eval_acceptance", S.stmt(f"""SELECT round(sum(n_pass) / sum(n_total), 4) AS overall_rate, bool_and(ok) AND bool_and(category <> {P.EVAL_STRICT_CATEGORY} OR n_pass = n_total) AND sum(n_pass) / sum(n_total) >= {P.EVAL_OVERALL} AS accepted FROM cat_rows""", *EVAL))
def eval_acceptance(spark, sf):
    return E.acceptance(E.category_results(_passed(spark, sf, "smart")))


def _compared(spark, sf):
    """Outcomes with the mean latency of a case, taken from all events dealt out to the cases; a case without events has none."""
    n = D.questions(spark, sf).count()
    ms = D.table(spark, sf, "events").groupBy((F.col("event_id") % n).alias("case_id")).agg(F.avg("value").alias("value"))
    a = _passed(spark, sf, "smart").join(ms, "case_id", "left").withColumn("latency_ms", F.col("value"))
    b = _passed(spark, sf, "hybrid").join(ms, "case_id", "left").withColumn("latency_ms", F.col("value") / 2)
    return E.compare(a, b)


@query("eval_ab", S.stmt("""SELECT count(*) FILTER (WHERE a_passed) AS a_pass, count(*) FILTER (WHERE b_passed) AS b_pass, round(avg(a_ms), 1) AS a_mean_ms, round(avg(b_ms), 1) AS b_mean_ms, count(*) AS n_cases,
 count(*) FILTER (WHERE b_passed) >= count(*) FILTER (WHERE a_passed) AS b_wins FROM ab""", *EVAL))
def eval_ab(spark, sf):
    return E.ab_summary(_compared(spark, sf))


@query("ab_regressions", S.stmt("SELECT case_id, CASE WHEN a_passed THEN 'regression' ELSE 'gain' END AS change FROM ab WHERE a_passed <> b_passed", *EVAL))
def ab_regressions(spark, sf):
    return _compared(spark, sf).filter("change <> 'same'").select("case_id", "change")


_BASELINE = "case_id bigint, category bigint, question string, passed boolean, topk array<struct<rank:bigint,ok:boolean,article_no:string,page:bigint,score:double,doc_name:string>>"


@query("write_eval_baseline", S.stmt("""SELECT cases.case_id, cases.category, question, passed, h.rank, ok, article_no, page, round(score, 4) AS score, doc_name
 FROM cases JOIN pass_a USING (case_id) LEFT JOIN (SELECT * FROM hits_a JOIN ok_a USING (case_id, rank) WHERE rank <= 5) h ON h.case_id = cases.case_id""", *EVAL))
def write_eval_baseline(spark, sf):
    """The written file, read back into columns."""
    path = D.scratch(spark, "eval-baseline", sf)
    hits = hits_of(spark, sf, "smart")
    results = E.predicate_results(hits, predicates(spark, sf))
    report = E.baseline_report(cases(spark, sf), results, E.case_results(cases(spark, sf), results), hits)
    report.write.mode("overwrite").json(path)
    rows = spark.read.schema("case_id bigint, json string").json(path).select(F.from_json("json", _BASELINE).alias("r")).select("r.*")
    return rows.select("case_id", "category", "question", "passed", F.explode_outer("topk").alias("t")).select("case_id", "category", "question", "passed", "t.*")


GATE = f"""findings AS (
 SELECT 'suspect_pages' AS finding, source_file, n_suspect AS value, n_suspect >= {P.SUSPECT_PAGES_MAX} AS fails FROM ({G.COVERAGE_SQL}) WHERE n_suspect > 0
 UNION ALL SELECT 'appendix_in_manual', '', n, true FROM (SELECT count(*) AS n FROM chunks WHERE contains(doc_name, '매뉴얼') AND starts_with(article_no, '별표')) WHERE n > {P.MANUAL_APPENDIX_MAX}
 UNION ALL SELECT 'lookup_' || kind, '', count(*), true FROM verified WHERE NOT ok GROUP BY kind
 UNION ALL SELECT 'dominant_document', doc_name, n_chunks, false FROM (SELECT doc_name, count(*) AS n_chunks FROM chunks GROUP BY 1) WHERE n_chunks / (SELECT count(*) FROM chunks) * 100 >= {P.DOMINANT_SHARE})"""


def findings(spark, sf):
    chunks = D.chunks(spark, sf)
    coverage = Z.page_coverage(G.page_lengths(spark, sf), chunks.withColumn("page", F.col("page").cast("bigint")))
    return Z.coverage_gate(coverage, Z.article_coverage(chunks), K.verified(spark, sf), Z.doc_distribution(chunks))


@query("coverage_findings", with_chunks(" SELECT * FROM findings", G.PAGE_LENGTHS, *K.LOOKUP_CTES, GATE))
def coverage_findings(spark, sf):
    return findings(spark, sf)


@query("coverage_gate", with_chunks(" SELECT NOT coalesce(bool_or(fails), false) AS overall_ok, count(*) AS n_findings, count(*) FILTER (WHERE fails) AS n_failing FROM findings", G.PAGE_LENGTHS, *K.LOOKUP_CTES, GATE))
def coverage_gate(spark, sf):
    return Z.gate_verdict(findings(spark, sf))


_REPORT = (
    "gate struct<overall_ok:boolean,n_findings:bigint,n_failing:bigint>, "
    "articles struct<n_chunks:bigint,n_labels:bigint,n_forced:bigint,forced_ratio:double,n_appendix_in_manual:bigint>, "
    "metrics struct<total:bigint,avg_len:double,max_len:bigint,n_blank:bigint,n_appendix_in_pdf:bigint>"
)


@query("write_coverage_report", with_chunks(f""" SELECT * FROM
 (SELECT NOT coalesce(bool_or(fails), false) AS overall_ok, count(*) AS n_findings, count(*) FILTER (WHERE fails) AS n_failing FROM findings),
 (SELECT count(*) AS n_chunks, count(DISTINCT article_no) AS n_labels, count(*) FILTER (WHERE contains(article_no, '(part ')) AS n_forced,
  round(avg(contains(article_no, '(part ')::INT), 6) AS forced_ratio, count(*) FILTER (WHERE contains(doc_name, '매뉴얼') AND starts_with(article_no, '별표')) AS n_appendix_in_manual FROM chunks),
 (SELECT count(*) AS total, round(avg(length(text)), 4) AS avg_len, max(length(text)) AS max_len, count(*) FILTER (WHERE article_no IN ('', {q(P.PREAMBLE_LABEL)})) AS n_blank,
  count(*) FILTER (WHERE starts_with(article_no, '별표 ') AND contains(lower(source_file), 'pdf')) AS n_appendix_in_pdf FROM chunks)""", G.PAGE_LENGTHS, *K.LOOKUP_CTES, GATE))
def write_coverage_report(spark, sf):
    """The verdict, the article report and the index metrics as one JSON row, read back into columns."""
    chunks = D.chunks(spark, sf)
    verdict = Z.gate_verdict(findings(spark, sf))
    parts = {"articles": Z.article_coverage(chunks), "metrics": Z.index_totals(chunks)}
    nested = {name: part.select(F.struct(*part.columns)).scalar().alias(name) for name, part in parts.items()}
    report = verdict.select(F.to_json(F.struct(F.struct(*verdict.columns).alias("gate"), *nested.values())).alias("json"))
    path = D.scratch(spark, "coverage-report", sf)
    report.write.mode("overwrite").text(path)
    rows = spark.read.text(path).select(F.from_json("value", _REPORT).alias("r")).select("r.gate.*", "r.articles.*", "r.metrics.*")
    return rows.withColumn("avg_len", F.round("avg_len", 4))
