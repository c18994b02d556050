"""Batch retrieval: candidate lists for all questions at once, pooled, boosted, ranked or fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions import questions as Q
from docspark.functions.names import nfc
from docspark.operators import bm25, dense, matching
from docspark.session import settle

# Candidate steps in arrival order.
VECTOR, PAGES, STRUCTURAL, PHRASES, KEYWORD_AND, COMPARISON, FANOUT, KEYWORDS = range(1, 9)


def project_hits(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hit columns with empty defaults, for rows that carry chunk_id and score."""
    keep = [c for c in scored.columns if c not in ("chunk_id", "score")]
    rows = scored.join(chunks, "chunk_id")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    return rows.select(
        *keep, F.col("chunk_id").alias("id"), "score", text("text").alias("text"),
        text("doc_name").alias("document_name"), text("doc_type").alias("document_type"),
        text("article_no").alias("article_no"), text("article_title").alias("article_title"),
        F.coalesce("page", F.lit(0)).alias("page"), text("effective_date").alias("effective_date"),
        text("source_file").alias("file_name"),
    )


def project_evidence(hits: DataFrame) -> DataFrame:
    keep = [c for c in ("question_id", "rank") if c in hits.columns]
    return hits.select(
        *keep, F.col("document_name").alias("doc_name"), F.col("document_type").alias("doc_type"), "article_no",
        "article_title", "page", "text",
    )


def of_type(chunks: DataFrame, doc_type: str | None) -> DataFrame:
    return chunks if doc_type is None else chunks.filter(F.col("doc_type") == doc_type)


def ranked(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def page_hits(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks on pages the question names, at most 20 per page: question_id, page, seq, chunk_id."""
    asked = questions.select("question_id", F.posexplode("target_pages").alias("seq", "page"))
    named = chunks.select("page", "chunk_id").join(asked.select("page").distinct(), "page", "left_semi")
    per_page = ranked(named, ["page"], P.PAGE_CANDIDATES, "chunk_id").drop("rank")
    return asked.join(per_page, "page")


def text_filters(questions: DataFrame) -> DataFrame:
    """Every filtered search of every question: question_id, step, seq, field, phrase, boost, scan_max."""

    def rows(source: DataFrame, step: int, field: str, boost: float, phrases: Column, scan: int) -> DataFrame:
        return source.select(
            "question_id", F.lit(step).alias("step"), F.posexplode(phrases).alias("seq", "phrase"),
            F.lit(field).alias("field"), F.lit(boost).alias("boost"), F.lit(scan).alias("scan_max"),
        )

    pairs = Q.phrase_pairs()
    some = F.size("keywords") >= 2
    both = " ".join(P.COMPARISON_WORDS)
    parts = [
        rows(questions, STRUCTURAL, "label", P.BOOST_STRUCTURAL, Q.structural_strings(), P.SCAN_CANDIDATES),
        rows(questions, PHRASES, "text", P.BOOST_PHRASE_PAIR, pairs, P.PHRASE_SCAN_MAX),
        rows(questions.filter(some), KEYWORD_AND, "text", P.BOOST_KEYWORD_AND, F.array(F.array_join("keywords", " ")), 0),
        rows(questions.filter("comparison_intent"), COMPARISON, "text", P.BOOST_COMPARISON, F.array(F.lit(both)), 0),
        rows(questions.filter(~some), KEYWORDS, "text", P.BOOST_KEYWORD, F.col("keywords"), 0),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filter_matches(filters: DataFrame, chunks: DataFrame, index: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """field, phrase, chunk_id for every distinct filter; ``index`` holds the words of the chunks, ``known`` in how many of them each occurs."""
    labels = filters.filter("field = 'label'").select(F.col("phrase").alias("needle")).distinct()
    label_hits = matching.label_matches(chunks, labels).select(
        F.lit("label").alias("field"), F.col("needle").alias("phrase"), "chunk_id"
    )
    phrases = filters.filter("field = 'text'").select("phrase").distinct()
    text_hits = matching.phrase_matches(chunks, index, phrases, known).select(F.lit("text").alias("field"), "phrase", "chunk_id")
    return label_hits.unionByName(text_hits)


def nearest_matches(filters: DataFrame, matches: DataFrame, questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every filtered search with its 15 nearest matching chunks: the filter columns, chunk_id, cosine."""
    keyed = filters.withColumn("asked", F.concat_ws(":", "question_id", "step", "seq"))
    wanted = keyed.select("field", "phrase", "asked", "question_id").join(questions.select("question_id", "embedding"), "question_id")
    best = dense.top_k_within(wanted.drop("question_id"), matches, vectors, ["field", "phrase"], P.FILTERED_CANDIDATES)
    return best.join(keyed, "asked").withColumnRenamed("score", "cosine").drop("asked", "rank")


def filtered_lists(filters: DataFrame, matches: DataFrame, nearest: DataFrame) -> DataFrame:
    """Vector-ordered lists (15 each) and scan lists of the filtered searches as candidate rows."""
    best = nearest.select(
        "question_id", "step", "seq", F.lit(0).alias("sub"), "chunk_id",
        F.round(F.col("cosine") + F.col("boost"), 6).alias("score"),
    )
    first = ranked(matches, ["field", "phrase"], P.SCAN_CANDIDATES, "chunk_id")
    counted = first.join(matches.groupBy("field", "phrase").agg(F.count("*").alias("n_matches")), ["field", "phrase"])
    scans = counted.join(filters.filter("scan_max > 0"), ["field", "phrase"]).filter(
        ((F.col("step") == STRUCTURAL) & (F.col("rank") <= F.col("scan_max")))
        | ((F.col("step") == PHRASES) & (F.col("n_matches") <= F.col("scan_max")))
    )
    scans = scans.select(
        "question_id", "step", "seq", F.lit(1).alias("sub"), "chunk_id",
        F.round(P.SCAN_SCORE + F.col("boost"), 6).alias("score"),
    )
    return best.unionByName(scans)


def category(doc_name: Column) -> Column:
    """First category word found in the document name."""
    return F.coalesce(
        *[F.when(F.contains(doc_name, F.lit(word)), F.lit(word)) for word in P.COMPARISON_CATEGORIES], F.lit("")
    )


def category_top1(nearest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best chunk of each category among the nearest 200 of a comparing question."""
    rows = nearest.join(chunks.select("chunk_id", "doc_name"), "chunk_id").withColumn("category", category(nfc(F.col("doc_name")))).drop("doc_name")
    return ranked(rows.filter("category <> ''").drop("rank"), ["question_id", "category"], 1, F.desc("score"), "chunk_id")


def candidates(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, index: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """question_id, step, seq, sub, chunk_id, score: all candidate lists in arrival order."""
    plain = dense.top_k(questions, vectors, P.VECTOR_CANDIDATES).select(
        "question_id", F.lit(VECTOR).alias("step"), F.lit(0).alias("seq"), F.lit(0).alias("sub"), "chunk_id", "score"
    )
    paged = page_hits(questions, chunks).select(
        "question_id", F.lit(PAGES).alias("step"), "seq", F.lit(0).alias("sub"), "chunk_id",
        F.lit(P.SCAN_SCORE + P.BOOST_PAGE).alias("score"),
    )
    filters = settle(text_filters(questions))
    matches = settle(filter_matches(filters, chunks, index, known))
    listed = filtered_lists(filters, matches, nearest_matches(filters, matches, questions, vectors))
    comparing = dense.top_k(questions.filter("comparison_intent"), vectors, P.FANOUT_CANDIDATES)
    fanned = category_top1(comparing, chunks).select(
        "question_id", F.lit(FANOUT).alias("step"), F.lit(0).alias("seq"), F.lit(0).alias("sub"), "chunk_id",
        F.round(F.col("score") + P.BOOST_FANOUT, 6).alias("score"),
    )
    return plain.unionByName(paged).unionByName(listed).unionByName(fanned)


def pool(rows: DataFrame) -> DataFrame:
    """Candidate rows folded per question and chunk in arrival order: the first score, then max(so far, next) + 0.02.

    A group holds one row per list the chunk is on, which the number of hints in the question bounds.
    """
    lists = F.array_sort(F.collect_list(F.struct("step", "seq", "sub", "score")))
    folded = rows.groupBy("question_id", "chunk_id").agg(lists.alias("lists"))
    rest = F.slice("lists", F.lit(2), F.size("lists"))
    score = F.aggregate(
        rest, F.get("lists", F.lit(0))["score"],
        lambda acc, x: F.greatest(acc, x["score"]) + P.REPEAT_BONUS,
    )
    return folded.select(
        "question_id", "chunk_id", F.round(score, 6).alias("score"), F.size("lists").cast("bigint").alias("n_sources")
    )


def doc_hint_boost(pooled: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pool rows whose document name contains the hinted name gain 0.20; no row is added."""
    rows = pooled.join(questions.select("question_id", "doc_name_hint"), "question_id").join(
        chunks.select("chunk_id", "doc_name"), "chunk_id"
    )
    hint = nfc(F.trim("doc_name_hint"))
    boosted = F.round(F.col("score") + P.BOOST_DOC_NAME, 6)
    return rows.withColumn(
        "score", F.when((hint != "") & F.contains(nfc(F.col("doc_name")), hint), boosted).otherwise(F.col("score"))
    ).drop("doc_name_hint")


def category_swap(pooled: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
    """Top-k rows; a comparing question gets the best row of every missing category in its last slots.

    ``pooled`` needs doc_name. Slots are taken from the last backwards in fixed category order, without re-sorting.
    """
    rows = pooled.join(questions.select("question_id", "comparison_intent"), "question_id")
    rows = rows.withColumn("category", category(nfc(F.col("doc_name"))))
    by_question = W.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    by_category = W.partitionBy("question_id", "category").orderBy(F.desc("score"), "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(by_question)).withColumn("place", F.row_number().over(by_category))
    selected = rows.filter(F.col("rank") <= top_k)
    have = selected.groupBy("question_id").agg(
        F.collect_set("category").alias("have"), F.count("*").cast("int").alias("n_selected")
    )
    order = F.array(*[F.lit(c) for c in P.COMPARISON_CATEGORIES])
    # The first row of a category the selection lacks is the first row of that category at all.
    spare = (
        rows.filter((F.col("rank") > top_k) & (F.col("place") == 1) & F.col("comparison_intent") & (F.col("category") != ""))
        .join(have, "question_id")
        .filter(~F.array_contains("have", F.col("category")) & (F.col("n_selected") >= 2))
    )
    turn = F.row_number().over(W.partitionBy("question_id").orderBy(F.array_position(order, F.col("category"))))
    columns = ["question_id", "slot", "chunk_id", "score", "doc_name", "n_sources"]
    swapped = spare.withColumn("slot", F.col("n_selected") - turn + 1).filter("slot >= 1").select(*columns)
    kept = selected.withColumn("slot", F.col("rank")).select(*columns)
    return kept.join(swapped.select("question_id", "slot"), ["question_id", "slot"], "left_anti").unionByName(
        swapped.select(*kept.columns)
    )


def smart_search(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, index: DataFrame, top_k: int = 8,
    doc_type: str | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """Boosted search. ``questions``: hint columns and embedding; result: question_id, slot, chunk_id, score, ...

    ``known``: the index's ``matching.vocabulary`` where it is kept; for one type it is only an upper bound of the counts, which does as well.
    """
    chunks = of_type(chunks, doc_type)
    if doc_type is not None:
        vectors = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        index = index.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    pooled = doc_hint_boost(pool(candidates(questions, chunks, vectors, index, known)), questions, chunks)
    return category_swap(pooled, questions, top_k)


def structural_topn(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, top_n: int = P.RRF_CANDIDATES
) -> DataFrame:
    """Label matches with the best cosine of each chunk (0.5 for those only scanned): question_id, chunk_id, score, rank."""
    filters = settle(text_filters(questions).filter("field = 'label'"))
    found = matching.label_matches(chunks, filters.select(F.col("phrase").alias("needle")).distinct())
    matches = settle(found.select(F.lit("label").alias("field"), F.col("needle").alias("phrase"), "chunk_id"))
    best = nearest_matches(filters, matches, questions, vectors)
    first = ranked(matches, ["field", "phrase"], P.SCAN_CANDIDATES, "chunk_id").drop("rank")
    scans = first.join(filters.select("field", "phrase", "question_id"), ["field", "phrase"])
    rows = best.select("question_id", "chunk_id", "cosine").unionByName(
        scans.select("question_id", "chunk_id", F.lit(None).cast("double").alias("cosine"))
    )
    per_chunk = rows.groupBy("question_id", "chunk_id").agg(
        F.coalesce(F.max("cosine"), F.lit(P.SCAN_SCORE)).alias("score")
    )
    return ranked(per_chunk, ["question_id"], top_n, F.desc("score"), "chunk_id")


def fuse(lists: dict[str, DataFrame], top_k: int) -> DataFrame:
    """Reciprocal rank fusion (k = 60) of ranked lists; equal sums fall back on the dense cosine."""
    rows = None
    for name, ranked_list in lists.items():
        part = ranked_list.select(
            "question_id", "chunk_id", (1.0 / (P.RRF_K + F.col("rank"))).alias("gain"),
            (F.col("score") if name == "dense" else F.lit(0.0)).alias("dense"),
        )
        rows = part if rows is None else rows.unionByName(part)
    summed = rows.groupBy("question_id", "chunk_id").agg(
        F.round(F.sum("gain"), 9).alias("rrf"), F.max("dense").alias("dense"), F.count("*").alias("n_lists")
    )
    return ranked(summed, ["question_id"], top_k, F.desc("rrf"), F.desc("dense"), "chunk_id")


def hybrid_search(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, index: DataFrame, terms: DataFrame,
    top_k: int = 8, doc_type: str | None = None,
) -> DataFrame:
    """Rank fusion of dense, BM25 and structural lists. The type filter meets BM25 only after its top 30.

    BM25 looks for the text that was embedded: ``searched`` where questions have it, else ``question``.
    """
    typed = of_type(chunks, doc_type)
    sparse = bm25.search(index, terms, questions, P.RRF_CANDIDATES, "searched" if "searched" in questions.columns else "question")
    if doc_type is not None:
        vectors = vectors.join(typed.select("chunk_id"), "chunk_id", "left_semi")
        kept = sparse.join(typed.select("chunk_id"), "chunk_id", "left_semi").drop("rank")
        sparse = ranked(kept, ["question_id"], P.RRF_CANDIDATES, F.desc("score"), "chunk_id")
    return fuse(
        {
            "dense": dense.top_k(questions, vectors, P.RRF_CANDIDATES),
            "bm25": sparse,
            "structural": structural_topn(questions, typed, vectors),
        },
        top_k,
    )


def confidence(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Confidence in percent and signal names per question; null confidence when there is no hit."""
    s = F.col("score")
    low = s < 1.0
    agg = questions.select("question_id").join(hits.select("question_id", "score"), "question_id", "left").groupBy(
        "question_id"
    ).agg(
        F.avg(F.when(low, s)).alias("mean"), F.coalesce(F.bool_or(s >= 1.3), F.lit(False)).alias("paged"),
        F.coalesce(F.bool_or((s >= 1.0) & (s < 1.3)), F.lit(False)).alias("structural"),
        F.coalesce(F.bool_or(low & (s > 0.75)), F.lit(False)).alias("phrase"),
    )
    paged, structural = F.col("paged"), F.col("structural")
    signals = F.array_compact(
        F.array(
            F.when(paged, "page"), F.when(structural, "structural"),
            F.when(F.col("phrase") & ~paged & ~structural, "phrase"),
        )
    )
    value = (
        F.when(F.col("mean").isNotNull(), F.least(F.col("mean") * 100, F.lit(95.0)))
        .when(paged, 92.0).when(structural, 87.0)
    )
    return agg.select("question_id", F.round(value, 4).alias("confidence"), F.array_join(signals, ",").alias("signals"))


def low_confidence(questions: DataFrame, hits: DataFrame, threshold: float = 0.65) -> DataFrame:
    """True for questions without a hit or with a best score under the threshold."""
    best = hits.groupBy("question_id").agg(F.max("score").alias("best"))
    return questions.select("question_id").join(best, "question_id", "left").select(
        "question_id", F.coalesce(F.col("best") < threshold, F.lit(True)).alias("needs_more")
    )
