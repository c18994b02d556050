"""The reference-shaped tables, derived from the given tables by Spark.

``corpus`` turns every document into a Korean-structured one (headers, appendix lines, item marks and phrases are woven
into its own lines), so the structural operators run over the whole text of the whole table.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import questions as Q
from docspark.operators import bm25, chunking, dense, hints, matching
from docspark.operators.search_index import SearchIndex, ingest
from docspark.session import materialize, scratch_path, spread

PAGE_CHARS = 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked_text(text, doc_id):
    """The document's lines with structural marks woven in by line number."""

    def line(c, i):
        k = (i + doc_id) % 11
        n = (i + 1).cast("string")
        head = F.left(c, F.lit(12))
        return (
            F.when(k == 1, F.concat(F.lit("① "), c, F.lit(" 연구활동비를 사용")))
            .when(k == 2, F.concat(c, F.lit(" 종전 혁신법에서는 비목")))
            .when(k == 3, F.concat(F.lit("제"), n, F.lit("조("), head, F.lit(")\n"), c))
            .when(k == 5, F.concat(F.lit(" 제"), n, F.lit("조의"), (doc_id % 3 + 2).cast("string"), F.lit(" ("), head,
                                   F.lit(") "), c))
            .when(k == 6, F.concat(F.lit("    제"), n, F.lit("조("), head, F.lit(")\n"), c))
            .when(k == 7, F.concat(F.lit("\n■ 별표 "), n, F.lit("\n"), c))
            .when(k == 8, F.concat(F.lit("부 칙\n"), n, F.lit(". "), c))
            .when(k == 9, F.concat(c, F.lit(" 「국가연구개발혁신법」 제"), n, F.lit("조제2항에 따라")))
            .when(k == 10, F.concat(F.lit("가) "), c))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def pages_of(text):
    """The text as numbered pages of PAGE_CHARS characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(PAGE_CHARS))
    return F.transform(
        starts,
        lambda s, i: F.struct((i + 1).cast("int").alias("page_num"),
                              F.substring(text, s + 1, F.lit(PAGE_CHARS)).alias("text")),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_name, doc_type, source_file, pages; written once per application."""
    return spread(materialize(spark, "corpus", sf_dir, lambda: _corpus(spark, sf_dir)))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = (
        F.when(F.col("lang") == "en", "시행령").when(F.col("lang") == "fr", "시행규칙")
        .when(F.col("lang") == "de", "매뉴얼").otherwise("FAQ")
    )
    name = F.concat(
        F.when(F.col("lang") == "en", "혁신법 시행령 ").when(F.col("lang") == "fr", "혁신법 시행규칙 ")
        .when(F.col("lang") == "de", "연구개발 매뉴얼 ").otherwise("혁신법 법률 "),
        F.col("source"),
    )
    appendix = F.col("source").isin("src3", "src9") & (F.col("lang") == "en")
    did = F.col("doc_id").cast("string")
    d = d.withColumn("doc_name", name).withColumn("doc_type", kind)
    d = spread(d).withColumn("marked", marked_text(F.col("text"), F.col("doc_id")))
    return d.select(
        "doc_id", "doc_name", "doc_type",
        F.when(
            appendix,
            F.concat(F.lit("[별표 "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("] "), "doc_name", F.lit("_"), did,
                     F.lit(".hwp")),
        ).otherwise(F.concat("doc_name", F.lit("_"), did, F.lit(".pdf"))).alias("source_file"),
        pages_of(F.col("marked")).alias("pages"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents as they are: doc_name = source, doc_type = lang."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", F.col("source").alias("doc_name"), F.col("lang").alias("doc_type"),
        F.col("doc_id").cast("string").alias("source_file"), pages_of(F.col("text")).alias("pages"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of the corpus, written once per application."""
    return materialize(spark, "chunks", sf_dir, lambda: chunking.chunk_documents(corpus(spark, sf_dir)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question: the benchmark texts, each with a legal wording that depends on its id."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    n, m, p = ((i % k + 1).cast("string") for k in (30, 3, 5))
    tail = (
        F.when(i % 6 == 0, F.concat(F.lit(" 제"), n, F.lit("조의"), m, F.lit(" 제2항 사용용도는?")))
        .when(i % 6 == 1, F.concat(F.lit(" 별표 "), n, F.lit(" 연구활동비를 사용 가능")))
        .when(i % 6 == 2, F.lit(" 종전 규정과 달라진 비목 연구활동비는 비교"))
        .when(i % 6 == 3, F.concat(F.lit(" "), p, F.lit("p 혹은 제"), n, F.lit(" 조 제3호")))
        .when(i % 6 == 4, F.concat(F.lit(" 별지 3 제7절 시행령에서는 제 "), n, F.lit("조")))
        .otherwise(F.lit(" 비목"))
    )
    return b.select(i.alias("question_id"), F.concat("text", tail).alias("question"))


def model_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hints a language model would supply per question, as a table."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    none = F.array().cast("array<string>")
    kind = (
        F.when(i % 7 == 0, "article_lookup").when(i % 7 == 1, "comparison").when(i % 7 == 2, "chat")
        .when(i % 7 == 3, "unknown").otherwise("open")
    )
    return b.select(
        i.alias("question_id"), kind.alias("kind"), F.when(i % 14 == 2, " 안녕하세요 ").otherwise("").alias("chat_response"),
        F.when(i % 5 == 0, F.array((i % 4).cast("int"), F.lit(12000))).otherwise(F.array().cast("array<int>"))
        .alias("target_pages"),
        F.when(i % 3 == 0, F.array(F.concat(F.lit(" 제"), (i % 30 + 1).cast("string"), F.lit("조 ")), F.lit("")))
        .otherwise(none).alias("target_articles"),
        none.alias("target_paragraphs"), none.alias("target_items"), none.alias("target_appendices"),
        none.alias("target_forms"), none.alias("target_sections"),
        F.when(i % 4 == 1, F.array(F.lit("혁신법에서는"), F.lit("비목"))).otherwise(none).alias("topic_keywords"),
        (i % 9 == 4).alias("comparison_intent"),
        F.when(i % 4 == 0, " 시행규칙").otherwise("").alias("doc_name_hint"),
        F.when(i % 8 == 3, F.concat(F.lit("다시 "), F.col("text"))).otherwise("").alias("rewritten_query"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(spark, "vectors", sf_dir, lambda: dense.embed_chunks(spread(chunks(spark, sf_dir))))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.listed(materialize(spark, "words", sf_dir, lambda: matching.chunk_words(spread(chunks(spark, sf_dir)))))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(spark, "vocabulary", sf_dir, lambda: matching.vocabulary(words(spark, sf_dir)))


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(spark, "bm25-index", sf_dir, lambda: bm25.chunk_terms(spread(chunks(spark, sf_dir))))


def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(spark, "bm25-terms", sf_dir, lambda: bm25.term_stats(bm25_index(spark, sf_dir)))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their merged hints, ``searched`` (the text to search) and its vector, written once: several candidate lists read them."""

    def build():
        merged = merged_hints(spark, sf_dir)
        return dense.embed_questions(merged.withColumn("searched", hints.searched_text()), "searched")

    return materialize(spark, "asked", sf_dir, build)


def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).drop("embedding", "searched")


def merged_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.merge_hints(Q.parse_questions(questions(spark, sf_dir)), model_hints(spark, sf_dir))


def scratch(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A folder of this application for a written result of one table set."""
    return scratch_path(spark, f"{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of this application that nothing has written yet."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def changed_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The corpus in a search index, by three runs, once per application.

    First come two thirds of the files, every fifth of them with its pages in reverse order and without the last one, and files that do not belong to the corpus;
    then the fifths as they are and the other files; then the foreign files go. Nobody else reads this index, so what a run replaces goes at once.
    """
    path = scratch(spark, "changed-index", sf_dir)
    index = SearchIndex(spark, path)
    if index.table.versions():
        return index
    docs, i = corpus(spark, sf_dir), F.col("doc_id")
    foreign = docs.filter(i % 7 == 0).withColumn("source_file", F.concat(F.lit("foreign "), "source_file"))
    early = docs.filter(i % 3 != 0).withColumn("pages", F.when(i % 5 == 0, F.slice(F.reverse("pages"), F.lit(1), F.greatest(F.size("pages") - 1, F.lit(1)))).otherwise(F.col("pages")))
    ingest(index, early.unionByName(foreign))
    ingest(index, docs.filter((i % 3 == 0) | (i % 5 == 0)))
    index.expire(1, -1)
    gone = foreign.select("source_file")
    index.update(spark.createDataFrame([], schemas.CHUNKS), gone)
    index.expire(1, -1)
    return index


def write_files(folder: str):
    """A task that writes rows (path, content) as files under a folder, and beside each one that holds something else."""

    def run(batches):
        files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                files.create_dir((root + path).rsplit("/", 1)[0], recursive=True)
                for name, held in ((path, content), (path + ".other", b"other")):
                    with files.open_output_stream(root + name) as out:
                        out.write(held)
            yield batch.select(["path"])

    return run
