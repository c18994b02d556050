"""Reports on the chunk table: coverage, distribution, metrics and rebuild checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions import text as X


def forced() -> Column:
    return F.contains("article_no", F.lit("(part "))


def article_coverage(chunks: DataFrame) -> DataFrame:
    manual_appendix = F.contains("doc_name", F.lit("매뉴얼")) & F.startswith("article_no", F.lit("별표"))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count_distinct("article_no").alias("n_labels"),
        F.count(F.when(forced(), 1)).alias("n_forced"),
        F.round(F.avg(forced().cast("double")), 6).alias("forced_ratio"),
        F.count(F.when(manual_appendix, 1)).alias("n_appendix_in_manual"),
    )


def multi_doc_articles(chunks: DataFrame) -> DataFrame:
    """Labels found in two documents or more, one row per label and document."""
    pairs = chunks.select("article_no", "doc_name").filter(
        (F.col("article_no") != "") & ~F.startswith("article_no", F.lit("(part")) & ~F.contains("article_no", F.lit("FAQ"))
    ).distinct()
    counts = pairs.groupBy("article_no").agg(F.count("*").alias("n_docs")).filter("n_docs > 1")
    return pairs.join(counts, "article_no")


def doc_distribution(chunks: DataFrame, top: int = 10) -> DataFrame:
    """Chunks per document name with their share; the ten largest, and an alarm when the first holds 95 %."""
    total = chunks.agg(F.count("*")).scalar()
    counts = chunks.groupBy("doc_name").agg(F.count("*").alias("n_chunks"))
    share = F.col("n_chunks") / total * 100
    return (
        counts.withColumn("share_pct", F.round(share, 4)).withColumn("alarm", share >= P.DOMINANT_SHARE)
        .orderBy(F.desc("n_chunks"), "doc_name").limit(top)
    )


def top_docs(chunks: DataFrame, top: int = 15) -> DataFrame:
    return chunks.groupBy("doc_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_name").limit(top)


def topic_diversity(hits: DataFrame) -> DataFrame:
    """Per question: hits, distinct documents, document counts and the first hit. A question has top-k hits at most."""
    per_doc = hits.groupBy("question_id", "document_name").agg(
        F.count("*").alias("n"), F.min(F.struct("slot", "document_name", "article_no", "page")).alias("first")
    )
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("document_name", "n"))))
    return per_doc.groupBy("question_id").agg(
        F.sum("n").alias("top_k"), F.count("*").alias("n_docs"), counts.alias("doc_counts"), F.min("first").alias("first")
    ).select(
        "question_id", "top_k", "n_docs", "doc_counts", F.col("first.document_name").alias("top1_doc"),
        F.col("first.article_no").alias("top1_article"), F.col("first.page").alias("top1_page"),
    )


def index_totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, mean and largest text length, blank or preamble labels and their share, appendix labels in PDF files. A null text or label counts as an empty one."""
    length = F.length(F.coalesce("text", F.lit("")))
    label = F.coalesce("article_no", F.lit(""))
    blank, appendix = label.isin("", P.PREAMBLE_LABEL), F.startswith(label, F.lit("별표 "))
    return chunks.agg(
        F.count("*").alias("total"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_len"),
        F.coalesce(F.max(length), F.lit(0)).cast("bigint").alias("max_len"), F.count(F.when(blank, 1)).alias("n_blank"),
        F.coalesce(F.avg(blank.cast("double")), F.lit(0.0)).alias("blank_share"),
        F.count(F.when(appendix & F.contains(F.lower("source_file"), F.lit("pdf")), 1)).alias("n_appendix_in_pdf"),
    )


def index_metrics(chunks: DataFrame) -> DataFrame:
    """The totals of the index (part ``index``), and the chunks (``total``) per document name (the 15 largest), document type and appendix, one row each."""
    totals = index_totals(chunks)
    parts = {"doc_name": top_docs(chunks), "doc_type": doc_types(chunks), "appendix": appendix_counts(chunks)}
    out = totals.select(F.lit("index").alias("part"), F.lit(None).cast("string").alias("name"), "*")
    for part, counts in parts.items():
        rows = counts.select(F.lit(part).alias("part"), F.col(part).alias("name"), F.col("n").alias("total"))
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def doc_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_type").agg(F.count("*").alias("n"))


def appendix_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per appendix of the appendix files, part suffix removed."""
    rows = chunks.filter(F.startswith("article_no", F.lit("별표 ")) & F.contains(F.lower("source_file"), F.lit(".hwp")))
    return rows.groupBy(F.split_part("article_no", F.lit(" (part"), F.lit(1)).alias("appendix")).agg(F.count("*").alias("n"))


def metrics_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta of five of the index's totals."""
    names = ("total", "avg_len", "max_len", "n_blank", "n_appendix_in_pdf")

    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select(*[F.round(c, 0).cast("bigint").alias(c) for c in names]).unpivot([], list(names), "metric", value)

    return long(before, "before").join(long(after, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def chunk_profile(chunks: DataFrame, group: str) -> DataFrame:
    """Per group: labels, parents, forced share, pages, the five most frequent parents and page-labelled chunks."""
    rows = chunks.withColumn("parent", F.split_part("article_no", F.lit(" (part"), F.lit(1)))
    per_parent = rows.groupBy(group, "parent").agg(F.count("*").alias("n"))
    order = W.partitionBy(group).orderBy(F.desc("n"), "parent")
    top = (
        per_parent.withColumn("r", F.row_number().over(order)).filter("r <= 5").groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("r", "parent", "n"))).alias("t"))
        .select(group, F.array_join(F.transform("t", lambda t: F.concat_ws(":", t["parent"], t["n"].cast("string"))), "|").alias("top_parents"))
    )
    profile = rows.groupBy(group).agg(
        F.count("*").alias("n_chunks"), F.count_distinct("article_no").alias("n_labels"),
        F.count_distinct("parent").alias("n_parents"), F.count(F.when(forced(), 1)).alias("n_forced"),
        F.round(F.avg(forced().cast("double")) * 100, 4).alias("forced_pct"),
        F.min("page").cast("bigint").alias("page_min"), F.max("page").cast("bigint").alias("page_max"),
        F.count_distinct("page").alias("n_pages"), F.count(F.when(F.startswith("article_no", F.lit("p.")), 1)).alias("n_page_labels"),
    )
    return profile.join(top, group)


def version_staleness(manifest: DataFrame) -> DataFrame:
    """Indexed files per chunker version, stale ones flagged."""
    return manifest.filter("indexed").groupBy("chunker_version").agg(F.count("*").alias("n_files")).withColumn(
        "stale", F.col("chunker_version") != P.CHUNKER_VERSION
    )


def keyword_hits(chunks: DataFrame) -> DataFrame:
    """Per appendix file: chunks, label-prefixed chunks, text length, chunks per keyword and the pass gates."""
    rows = chunks.filter(F.regexp_like("source_file", F.lit(P.APPENDIX_FILE_PATTERN)))
    number = F.regexp_extract("source_file", P.APPENDIX_FILE_PATTERN, 1)
    prefixed = F.startswith("article_no", F.concat(F.lit("별표 "), number)) | F.startswith("article_no", F.concat(F.lit("별표"), number))
    hits = [F.count(F.when(F.contains("text", F.lit(k)), 1)).alias(f"kw{i}") for i, k in enumerate(P.REBUILD_KEYWORDS)]
    out = rows.groupBy("source_file").agg(
        F.count("*").alias("n_chunks"), F.count(F.when(prefixed, 1)).alias("n_labelled"),
        F.sum(F.length("text")).alias("text_len"), *hits,
    )
    all_hit = F.lit(True)
    for i in range(len(P.REBUILD_KEYWORDS)):
        all_hit = all_hit & (F.col(f"kw{i}") >= 1)
    return out.withColumn("pass_chunks", F.col("n_labelled") >= P.REBUILD_MIN_CHUNKS).withColumn(
        "pass_chars", F.col("text_len") >= P.REBUILD_MIN_CHARS
    ).withColumn("pass_keywords", all_hit)


def keyword_coverage(chunks: DataFrame) -> DataFrame:
    """Per file: which keywords occur anywhere in its chunks, and whether six of seven do."""
    present = [F.bool_or(F.contains("text", F.lit(k))).alias(f"kw{i}") for i, k in enumerate(P.COVERAGE_KEYWORDS)]
    out = chunks.groupBy("source_file").agg(*present)
    count = F.lit(0).cast("bigint")
    for i in range(len(P.COVERAGE_KEYWORDS)):
        count = count + F.col(f"kw{i}").cast("bigint")
    return out.select("source_file", count.alias("n_present"), (count >= P.COVERAGE_MIN_PRESENT).alias("pass"))


def label_format_check(chunks: DataFrame) -> DataFrame:
    """Per appendix file: whether every label has the appendix form, and the number that has not."""
    rows = chunks.filter(F.regexp_like("source_file", F.lit(P.APPENDIX_FILE_PATTERN)))
    good = F.regexp_like("article_no", F.lit(P.APPENDIX_LABEL))
    return rows.groupBy("source_file").agg(F.bool_and(good).alias("uniform"), F.count(F.when(~good, 1)).alias("n_offenders"))


def adjacent_keywords(chunks: DataFrame, first: str, second: str) -> DataFrame:
    """Per file: parts in order; does the first part with one word lie next to the first part with the other?"""
    rows = chunks.select("source_file", "text", F.struct(X.part_number(F.col("article_no")).alias("part"), "chunk_id").alias("key"))

    def seen(word: str) -> Column:
        return F.min(F.when(F.contains("text", F.lit(word)), F.col("key")))

    # A position is the number of parts before it, so sums do and no file has to be sorted in one task.
    keys = rows.groupBy("source_file").agg(seen(first).alias("first_key"), seen(second).alias("second_key"))

    def before(key: str) -> Column:
        return F.when(F.max(key).isNotNull(), F.count(F.when(F.col("key") < F.col(key), 1)))

    out = rows.select("source_file", "key").join(keys, "source_file").groupBy("source_file").agg(
        before("first_key").alias("first_at"), before("second_key").alias("second_at")
    )
    return out.withColumn("adjacent", F.coalesce(F.abs(F.col("first_at") - F.col("second_at")) <= 1, F.lit(False)))


def reindex_report(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per target file (source_file, found, text_len): status, chunks and their text length."""
    counts = chunks.groupBy("source_file").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    status = (
        F.when(~F.col("found"), "missing").when(F.col("text_len") == 0, "parse_empty")
        .when(F.col("n").isNull(), "chunk_empty").otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return targets.join(counts, "source_file", "left").withColumn("status", status).select(
        "source_file", "status", F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("chunk_count"),
        F.when(ok, F.col("chars")).when(F.col("status") == "chunk_empty", F.col("text_len")).otherwise(F.lit(0)).alias("text_len_total"),
    )


def label_distribution(chunks: DataFrame) -> DataFrame:
    """Chunks per file and label."""
    return chunks.groupBy("source_file", "article_no").agg(F.count("*").alias("n"))


def uncovered_pages(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages (source_file, page_num, n_chars) that no chunk starts on, with ``suspect`` for those holding text."""
    have = chunks.select("source_file", F.col("page").alias("page_num")).distinct()
    return pages.join(have, ["source_file", "page_num"], "left_anti").withColumn(
        "suspect", F.col("n_chars") >= P.PAGE_NONEMPTY_CHARS
    )


def page_coverage(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    totals = pages.groupBy("source_file").agg(F.count("*").alias("n_pages"))
    gaps = uncovered_pages(pages, chunks).groupBy("source_file").agg(
        F.count(F.when(~F.col("suspect"), 1)).alias("n_blank"), F.count(F.when(F.col("suspect"), 1)).alias("n_suspect")
    )
    rows = totals.join(gaps, "source_file", "left").na.fill(0, ["n_blank", "n_suspect"])
    covered = F.col("n_pages") - F.col("n_blank") - F.col("n_suspect")
    return rows.select(
        "source_file", "n_pages", covered.alias("n_with_chunks"), "n_blank", "n_suspect",
        F.round(covered / F.col("n_pages") * 100, 4).alias("coverage_pct"),
    )


PAGE_STRETCH = 4096


def page_ranges(pages: DataFrame) -> DataFrame:
    """Contiguous page numbers (source_file, page_num) as ranges.

    Stretches of pages are collapsed first, so that what remains to be merged per file is ranges, not pages.
    """
    stretch = F.floor(F.col("page_num") / PAGE_STRETCH)
    near = W.partitionBy("source_file", "stretch").orderBy("page_num")
    rows = pages.select("source_file", "page_num", stretch.alias("stretch"))
    local = rows.withColumn("island", F.col("page_num") - F.row_number().over(near)).groupBy(
        "source_file", "stretch", "island"
    ).agg(F.min("page_num").alias("low"), F.max("page_num").alias("high"))
    whole = W.partitionBy("source_file").orderBy("low")
    opens = (F.col("low") > F.lag("high").over(whole) + 1).cast("int")
    merged = local.withColumn("opens", F.coalesce(opens, F.lit(1))).withColumn("island", F.sum("opens").over(whole))
    return merged.groupBy("source_file", "island").agg(
        F.min("low").alias("first_page"), F.max("high").alias("last_page")
    ).drop("island")


def coverage_gate(coverage: DataFrame, articles: DataFrame, lookups: DataFrame, spread: DataFrame) -> DataFrame:
    """Findings of the single reports with whether each one fails the gate."""
    suspect = F.col("n_suspect")
    parts = [
        coverage.filter(suspect > 0).select(
            F.lit("suspect_pages").alias("finding"), "source_file", suspect.alias("value"),
            (suspect >= P.SUSPECT_PAGES_MAX).alias("fails"),
        ),
        articles.filter(F.col("n_appendix_in_manual") > P.MANUAL_APPENDIX_MAX).select(
            F.lit("appendix_in_manual").alias("finding"), F.lit("").alias("source_file"),
            F.col("n_appendix_in_manual").alias("value"), F.lit(True).alias("fails"),
        ),
        lookups.filter(~F.col("ok")).groupBy("kind").agg(F.count("*").alias("value")).select(
            F.concat(F.lit("lookup_"), "kind").alias("finding"), F.lit("").alias("source_file"), "value", F.lit(True).alias("fails")
        ),
        spread.filter("alarm").select(
            F.lit("dominant_document").alias("finding"), F.col("doc_name").alias("source_file"),
            F.col("n_chunks").alias("value"), F.lit(False).alias("fails"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gate_verdict(findings: DataFrame) -> DataFrame:
    return findings.agg(
        (~F.coalesce(F.bool_or("fails"), F.lit(False))).alias("overall_ok"), F.count("*").alias("n_findings"),
        F.count(F.when(F.col("fails"), 1)).alias("n_failing"),
    )
