"""Registered queries: index, questions and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions import questions as Q
from docspark.functions import tokens as T
from docspark.operators import bm25, dense
from docspark.operators import retrieve as R
from docspark.plans import derived as D
from docspark.plans.oracle import search as S
from docspark.plans.registry import query
from docspark.session import settle

LISTS = ("article_nos", "paragraphs", "items", "appendices", "forms", "sections", "keywords", "doc_type_hints")


def _joined(names, sep="|"):
    return [F.array_join(F.col(n), sep).alias(n) for n in names]


def _joined_sql(names, sep="|"):
    return ", ".join(f"array_to_string({n}, '{sep}') AS {n}" for n in names)


def _pages():
    return F.array_join(F.transform("target_pages", lambda p: p.cast("string")), ",").alias("target_pages")


_PAGES_SQL = "array_to_string(target_pages, ',') AS target_pages"


@query("index_count", S.stmt("SELECT count(*) AS n_points FROM chunks", *S.INDEX))
def index_count(spark, sf):
    return D.chunks(spark, sf).agg(F.count("*").alias("n_points"))


@query("tokenize_korean", S.stmt("SELECT chunk_id, len(toks)::BIGINT AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM chunk_tokens", *S.INDEX))
def tokenize_korean(spark, sf):
    rows = D.chunks(spark, sf).select("chunk_id", T.chunk_tokens().alias("t"))
    return rows.select("chunk_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query("extract_hints", S.stmt(f"SELECT question_id, {_joined_sql(LISTS[:6])} FROM parsed", S.QUESTIONS, S.PARSED))
def extract_hints(spark, sf):
    return Q.parse_questions(D.questions(spark, sf)).select("question_id", *_joined(LISTS[:6]))


@query("extract_pages", S.stmt(f"SELECT question_id, {_PAGES_SQL} FROM parsed", S.QUESTIONS, S.PARSED))
def extract_pages(spark, sf):
    return Q.parse_questions(D.questions(spark, sf)).select("question_id", _pages())


@query("extract_keywords", S.stmt("SELECT question_id, array_to_string(keywords, '|') AS keywords FROM parsed", S.QUESTIONS, S.PARSED))
def extract_keywords(spark, sf):
    return Q.parse_questions(D.questions(spark, sf)).select("question_id", *_joined(["keywords"]))


@query("doc_type_hints", S.stmt("SELECT question_id, array_to_string(doc_type_hints, '|') AS doc_type_hints FROM parsed", S.QUESTIONS, S.PARSED))
def doc_type_hints(spark, sf):
    return Q.parse_questions(D.questions(spark, sf)).select("question_id", *_joined(["doc_type_hints"]))


@query("comparison_intent", S.stmt("SELECT question_id, comparison_intent FROM parsed", S.QUESTIONS, S.PARSED))
def comparison_intent(spark, sf):
    return Q.parse_questions(D.questions(spark, sf)).select("question_id", "comparison_intent")


@query("parse_query", S.stmt(f"SELECT question_id, {_joined_sql(LISTS)}, {_PAGES_SQL}, comparison_intent, 'open' AS kind, question AS rewritten_query FROM parsed", S.QUESTIONS, S.PARSED))
def parse_query(spark, sf):
    return Q.parse_questions(D.questions(spark, sf)).select(
        "question_id", *_joined(LISTS), _pages(), "comparison_intent", "kind", "rewritten_query"
    )


@query("merge_hints", S.stmt(
    f"SELECT question_id, {_joined_sql(LISTS)}, {_PAGES_SQL}, comparison_intent, kind, doc_name_hint, chat_response, rewritten_query FROM hinted", *S.ASK))
def merge_hints(spark, sf):
    return D.merged_hints(spark, sf).select(
        "question_id", *_joined(LISTS), _pages(), "comparison_intent", "kind", "doc_name_hint", "chat_response", "rewritten_query"
    )


@query("structural_strings", S.stmt(f"SELECT question_id, array_to_string({S.STRUCTURAL_STRINGS}, '|') AS labels FROM hinted", *S.ASK))
def structural_strings(spark, sf):
    return D.hinted(spark, sf).select("question_id", F.array_join(Q.structural_strings(), "|").alias("labels"))


@query("phrase_pairs", S.stmt(f"SELECT question_id, array_to_string({S.PHRASE_PAIRS}, '|') AS pairs FROM hinted", *S.ASK))
def phrase_pairs(spark, sf):
    return D.hinted(spark, sf).select("question_id", F.array_join(Q.phrase_pairs(), "|").alias("pairs"))


@query("embed_chunks", S.stmt("SELECT chunk_id, array_to_string(list_transform(vec, lambda x: x::BIGINT), ',') AS counts FROM vectors", *S.INDEX, S.VECTORS))
def embed_chunks(spark, sf):
    rows = dense.embed_chunks(D.spread(D.chunks(spark, sf)))
    return rows.select("chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",").alias("counts"))


def _given_vectors(spark, sf):
    return D.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


def _given_questions(spark, sf):
    """Benchmark items with the vector of the same id."""
    v = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    return D.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id")).join(v, "question_id")


_GIVEN = (
    "SELECT item_id AS question_id, v.vec_id::VARCHAR AS chunk_id, "
    + S.cosine("e.embedding::DOUBLE[]", "v.embedding::DOUBLE[]")
    + " AS score, v.label FROM benchmark JOIN embeddings e ON item_id = e.vec_id, embeddings v"
)


def _top_sql(k: int, where: str = "true") -> str:
    return (
        f"SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, "
        f"chunk_id) AS rank FROM ({_GIVEN}) WHERE {where}) WHERE rank <= {k}"
    )


@query("validate_embeddings", """SELECT count(*) AS n_total, count(*) FILTER (WHERE len(embedding) <> 64) AS n_wrong_dim,
 min(CASE WHEN len(embedding) <> 64 THEN vec_id::VARCHAR END) AS first_wrong,
 count(*) FILTER (WHERE list_bool_and(list_transform(embedding, lambda x: x = 0))) AS n_zero FROM embeddings""")
def validate_embeddings(spark, sf):
    return dense.validate(_given_vectors(spark, sf), 64)


@query("vector_topk", _top_sql(8))
def vector_topk(spark, sf):
    out = dense.top_k(_given_questions(spark, sf), _given_vectors(spark, sf), 8)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("filtered_vector_topk", _top_sql(P.FILTERED_CANDIDATES, "label >= 5"))
def filtered_vector_topk(spark, sf):
    out = dense.top_k(_given_questions(spark, sf), _given_vectors(spark, sf).filter("label >= 5"), P.FILTERED_CANDIDATES)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("join_embeddings", """SELECT doc_id, lang, label::BIGINT AS label, v.vec_id IS NOT NULL AS has_vector
 FROM documents LEFT JOIN embeddings v ON doc_id = vec_id""")
def join_embeddings(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "lang")
    joined, missing = dense.join_embeddings(docs, _given_vectors(spark, sf))
    columns = ["doc_id", "lang", F.col("label").cast("bigint").alias("label")]
    return joined.select(*columns, F.lit(True).alias("has_vector")).unionByName(
        missing.select("doc_id", "lang", F.lit(None).cast("bigint").alias("label"), F.lit(False).alias("has_vector"))
    )


@query("cosine_pairs", S.stmt(
    f"SELECT question_id, chunk_id, {S.cosine('qvec', 'vec')} AS score FROM bm25 JOIN asked USING (question_id) JOIN vectors USING (chunk_id)",
    *S.INDEX, *S.ASK, S.VECTORS, S.ASKED, S.BM25))
def cosine_pairs(spark, sf):
    """Cosine of the pairs the inverted index proposes."""
    asked = D.asked(spark, sf)
    pairs = bm25.search(D.bm25_index(spark, sf), D.bm25_terms(spark, sf), asked, text="searched").select("question_id", "chunk_id")
    return dense.score_pairs(pairs, asked, D.vectors(spark, sf)).select("question_id", "chunk_id", "score")


_POSTINGS = "SELECT chunk_id, doc_len::BIGINT AS doc_len, term, tf, df, round(idf, 6) AS idf FROM postings JOIN idf USING (term)"


def _postings(index, terms):
    return bm25.postings(index, terms).select("chunk_id", "doc_len", "term", "tf", "df", F.round("idf", 6).alias("idf"))


@query("bm25_index", S.stmt(_POSTINGS, *S.INDEX, *S.ASK, S.BM25))
def bm25_index(spark, sf):
    return _postings(D.bm25_index(spark, sf), D.bm25_terms(spark, sf))


@query("incremental_index", S.stmt(_POSTINGS, *S.INDEX, *S.ASK, S.BM25))
def incremental_index(spark, sf):
    """The index after two changes and a deletion, which must be that of the whole corpus: the terms."""
    index = D.changed_index(spark, sf)
    return _postings(index.postings(), index.terms())


@query("incremental_vectors", S.stmt("SELECT chunk_id, array_to_string(list_transform(vec, lambda x: x::BIGINT), ',') AS counts FROM vectors", *S.INDEX, S.VECTORS))
def incremental_vectors(spark, sf):
    """The same: the vectors."""
    rows = D.changed_index(spark, sf).vectors()
    return rows.select("chunk_id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",").alias("counts"))


@query("bm25_search", S.stmt("SELECT question_id, chunk_id, score, rank FROM bm25", *S.INDEX, *S.ASK, S.BM25))
def bm25_search(spark, sf):
    out = bm25.search(D.bm25_index(spark, sf), D.bm25_terms(spark, sf), D.asked(spark, sf), text="searched")
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("filter_doc_type", S.stmt(
    f"""SELECT * FROM (SELECT question_id, chunk_id, cosine AS score, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, chunk_id) AS rank
 FROM cos JOIN chunks USING (chunk_id) WHERE doc_type = '시행령') WHERE rank <= 8""", *S.INDEX, *S.ASK, S.VECTORS, S.ASKED, S.NEAREST))
def filter_doc_type(spark, sf):
    kept = R.of_type(D.chunks(spark, sf), "시행령").select("chunk_id")
    out = dense.top_k(D.asked(spark, sf), D.vectors(spark, sf).join(kept, "chunk_id", "left_semi"), 8)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("filter_pages", S.stmt("SELECT question_id, chunk_id, seq, score::DOUBLE AS score FROM candidates WHERE step = 2", *S.SMART))
def filter_pages(spark, sf):
    hits = R.page_hits(D.asked(spark, sf), D.chunks(spark, sf))
    return hits.select("question_id", "chunk_id", F.col("seq").cast("bigint").alias("seq"), F.lit(P.SCAN_SCORE + P.BOOST_PAGE).alias("score"))


@query("match_text", S.stmt("SELECT DISTINCT field, phrase, chunk_id FROM matches", *S.SMART))
def match_text(spark, sf):
    return R.filter_matches(R.text_filters(D.asked(spark, sf)), D.chunks(spark, sf), D.words(spark, sf), D.vocabulary(spark, sf))


def _filtered(spark, sf, step):
    asked = D.asked(spark, sf)
    filters = R.text_filters(asked).filter(F.col("step") == step)
    chunks = D.chunks(spark, sf)
    matches = settle(R.filter_matches(filters, chunks, D.words(spark, sf), D.vocabulary(spark, sf)))
    nearest = R.nearest_matches(filters, matches, asked, D.vectors(spark, sf))
    return R.filtered_lists(filters, matches, nearest).select(
        "question_id", F.col("seq").cast("bigint").alias("seq"), F.col("sub").cast("bigint").alias("sub"), "chunk_id", "score"
    )


_FILTERED_SQL = "SELECT question_id, seq, sub::BIGINT AS sub, chunk_id, score::DOUBLE AS score FROM candidates WHERE step = "


@query("keyword_and", S.stmt(_FILTERED_SQL + "5", *S.SMART))
def keyword_and(spark, sf):
    return _filtered(spark, sf, R.KEYWORD_AND)


@query("structural_match", S.stmt(_FILTERED_SQL + "3", *S.SMART))
def structural_match(spark, sf):
    return _filtered(spark, sf, R.STRUCTURAL)


@query("category_top1", S.stmt("SELECT question_id, chunk_id, score::DOUBLE AS score FROM candidates WHERE step = 7", *S.SMART))
def category_top1(spark, sf):
    asked = D.asked(spark, sf).filter("comparison_intent")
    nearest = dense.top_k(asked, D.vectors(spark, sf), P.FANOUT_CANDIDATES)
    return R.category_top1(nearest, D.chunks(spark, sf)).select(
        "question_id", "chunk_id", F.round(F.col("score") + P.BOOST_FANOUT, 6).alias("score")
    )


def _candidates(spark, sf):
    return D.materialize(spark, "candidates", sf, lambda: R.candidates(D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf), D.words(spark, sf), D.vocabulary(spark, sf)))


@query("candidate_pool", S.stmt("SELECT question_id, chunk_id, score, n_sources FROM pooled", *S.SMART))
def candidate_pool(spark, sf):
    return R.pool(_candidates(spark, sf))


@query("doc_hint_boost", S.stmt("SELECT question_id, chunk_id, score FROM boosted", *S.SMART))
def doc_hint_boost(spark, sf):
    out = R.doc_hint_boost(R.pool(_candidates(spark, sf)), D.asked(spark, sf), D.chunks(spark, sf))
    return out.select("question_id", "chunk_id", "score")


@query("pool_rank", S.stmt("SELECT question_id, chunk_id, score, rank FROM smart_ranked WHERE rank <= 8", *S.SMART))
def pool_rank(spark, sf):
    pooled = R.doc_hint_boost(R.pool(_candidates(spark, sf)), D.asked(spark, sf), D.chunks(spark, sf))
    out = R.ranked(pooled, ["question_id"], 8, F.desc("score"), "chunk_id")
    return out.select("question_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("category_swap", S.stmt("SELECT question_id, slot, chunk_id, doc_name FROM smart", *S.SMART))
def category_swap(spark, sf):
    pooled = R.doc_hint_boost(R.pool(_candidates(spark, sf)), D.asked(spark, sf), D.chunks(spark, sf))
    out = R.category_swap(pooled, D.asked(spark, sf), 8)
    return out.select("question_id", F.col("slot").cast("bigint").alias("slot"), "chunk_id", "doc_name")


@query("smart_search", S.stmt("SELECT question_id, slot, chunk_id, score, n_sources FROM smart", *S.SMART))
def smart_search(spark, sf):
    out = R.smart_search(D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf), D.words(spark, sf), known=D.vocabulary(spark, sf))
    return out.select("question_id", F.col("slot").cast("bigint").alias("slot"), "chunk_id", "score", "n_sources")


@query("smart_search_typed", S.stmt("SELECT question_id, slot, chunk_id, score, n_sources FROM smart", *S.typed(S.SMART, "시행령")))
def smart_search_typed(spark, sf):
    """The boosted search among the chunks of one document type."""
    out = R.smart_search(D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf), D.words(spark, sf), doc_type="시행령", known=D.vocabulary(spark, sf))
    return out.select("question_id", F.col("slot").cast("bigint").alias("slot"), "chunk_id", "score", "n_sources")


def smart_hits(spark, sf):
    """Result of the boosted search, written once for the queries that go on from it."""
    return D.materialize(
        spark, "smart-hits", sf,
        lambda: R.smart_search(D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf), D.words(spark, sf), known=D.vocabulary(spark, sf)),
    )


_HITS = """SELECT question_id, slot, chunk_id AS id, score, md5(text) AS text_md5, doc_name AS document_name, doc_type AS document_type, article_no,
 article_title, page, effective_date, source_file AS file_name FROM smart JOIN (SELECT * EXCLUDE (doc_name), doc_name AS dn FROM chunks) USING (chunk_id)"""


@query("project_hits", S.stmt(_HITS, *S.SMART))
def project_hits(spark, sf):
    hits = smart_hits(spark, sf).select("question_id", F.col("slot").cast("bigint").alias("slot"), "chunk_id", "score")
    out = R.project_hits(hits, D.chunks(spark, sf))
    return out.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text").withColumn("page", F.col("page").cast("bigint"))


@query("project_evidence", S.stmt("""SELECT question_id, slot AS rank, doc_name, doc_type, article_no, article_title, page, text
 FROM smart JOIN (SELECT * EXCLUDE (doc_name) FROM chunks) USING (chunk_id)""", *S.SMART))
def project_evidence(spark, sf):
    hits = smart_hits(spark, sf).select("question_id", F.col("slot").cast("bigint").alias("rank"), "chunk_id", "score")
    out = R.project_evidence(R.project_hits(hits, D.chunks(spark, sf)))
    return out.withColumn("page", F.col("page").cast("bigint"))


@query("structural_topn", S.stmt("SELECT question_id, chunk_id, score::DOUBLE AS score, rank FROM structural", *S.SMART, S.STRUCTURAL))
def structural_topn(spark, sf):
    out = R.structural_topn(D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf))
    return out.select("question_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("hybrid_search", S.stmt("SELECT question_id, chunk_id, rrf, n_lists, rank FROM fused", *S.SMART, S.STRUCTURAL, S.BM25, S.FUSED))
def hybrid_search(spark, sf):
    out = R.hybrid_search(
        D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf), D.bm25_index(spark, sf), D.bm25_terms(spark, sf)
    )
    return out.select("question_id", "chunk_id", "rrf", "n_lists", F.col("rank").cast("bigint").alias("rank"))


@query("hybrid_search_typed", S.stmt("SELECT question_id, chunk_id, rrf, n_lists, rank FROM fused", *S.typed([*S.SMART, S.STRUCTURAL, S.BM25, S.FUSED], "시행령")))
def hybrid_search_typed(spark, sf):
    """Rank fusion among the chunks of one document type; BM25 ranks all chunks and is filtered after its top 30."""
    out = R.hybrid_search(
        D.asked(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf), D.bm25_index(spark, sf), D.bm25_terms(spark, sf), doc_type="시행령"
    )
    return out.select("question_id", "chunk_id", "rrf", "n_lists", F.col("rank").cast("bigint").alias("rank"))



@query("confidence", S.stmt("""SELECT question_id, round(CASE WHEN mean IS NOT NULL THEN least(mean * 100, 95.0) WHEN paged THEN 92.0 WHEN structural THEN 87.0 END::DOUBLE, 4) AS confidence,
 concat_ws(',', CASE WHEN paged THEN 'page' END, CASE WHEN structural THEN 'structural' END, CASE WHEN phrase AND NOT paged AND NOT structural THEN 'phrase' END) AS signals
 FROM (SELECT question_id, avg(score) FILTER (WHERE score < 1.0) AS mean, coalesce(bool_or(score >= 1.3), false) AS paged,
  coalesce(bool_or(score >= 1.0 AND score < 1.3), false) AS structural, coalesce(bool_or(score > 0.75 AND score < 1.0), false) AS phrase
  FROM asked LEFT JOIN smart USING (question_id) GROUP BY question_id)""", *S.SMART))
def confidence(spark, sf):
    return R.confidence(D.asked(spark, sf), smart_hits(spark, sf))


@query("low_confidence", S.stmt(f"SELECT q.question_id, coalesce(max(score) < 0.65, true) AS needs_more FROM ({_top_sql(8)}) h RIGHT JOIN (SELECT item_id AS question_id FROM benchmark) q USING (question_id) GROUP BY q.question_id", "one AS (SELECT 1)"))
def low_confidence(spark, sf):
    """Pure vector hits without the question itself being certain to be found."""
    asked = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"))
    return R.low_confidence(asked, dense.top_k(_given_questions(spark, sf), _given_vectors(spark, sf), 8))
