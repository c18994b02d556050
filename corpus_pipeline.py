"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes each result as Parquet and reads it again.
SQL cannot express the language model's inference, so tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import language, line_dedup, mixing, ngram_join, packing
from docspark.llm.scratch import settle
from docspark.session import ship_package

LEAST_FIT = 0.0
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose trigrams the learned languages together explain less than chance does, go; a missing lang is filled in.

    A text in any number of learned languages stays. With nothing to learn from, every text with a letter stays and a missing lang becomes ``und``.
    """
    ship_package(spark)
    model = language.fit(docs)
    if not model.languages:
        known = docs.filter(F.col("text").rlike(r"\p{L}"))
        return known.select(*(F.coalesce("lang", F.lit("und")).alias("lang") if c == "lang" else c for c in docs.columns))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = language.predict(rows, model, ["doc"], fitted=True)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("fit") >= LEAST_FIT))
    lang = F.coalesce("doc.lang", "lang_pred").alias("lang")
    return kept.select(*(lang if c == "lang" else F.col(f"doc.{c}") for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut out; documents of which no word is left go."""
    left = line_dedup.deduplicate(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(line_dedup.WORD))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows linked by 80 % of equal 5-word shingles, one stays: the one with the smallest id (a null id only where there is no other), then text hash.

    Rows without a word all stay. Rows with the id and text of one that stays are the same document again; only these few are shuffled by their key.
    """
    ship_package(spark)
    joined = ngram_join.join(docs, 5, 80, 100, marked=True).select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"), "component")
    rows = joined.groupBy("component", "kept_id", "kept_mark").agg(F.count("*").alias("times"))
    order = F.struct(F.col("kept_id").isNull().alias("null_id"), "kept_id", "kept_mark", "times")
    heads = rows.filter("component is not null").groupBy("component").agg(F.min(order).alias("head")).select("head.kept_id", "head.kept_mark", "head.times")
    kept = settle(heads.union(rows.filter("component is null").select("kept_id", "kept_mark", F.lit(1).cast("bigint"))))
    repeated = settle(kept.filter("times > 1").drop("times"))
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("mark"))
    met = F.col("doc.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    once = marked.join(kept.filter("times = 1").drop("times"), met, "left_semi")
    again = marked.join(repeated, met, "left_semi").select("*", F.col("doc.doc_id").alias("doc_id")).dropDuplicates(["doc_id", "mark"])
    return once.select("doc.*").union(again.select("doc.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of all sources: a row for every pass over a source that takes words of a document."""
    mixed = mixing.mixed_texts(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the mixture in optimal length buckets."""
    return packing.pack(docs, keep=("lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("source_mixing", mix_sources),
    ("length_packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
