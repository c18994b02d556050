"""The registered queries opN_<name> and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bpe, fingerprint, language, line_dedup, mixing, ngram_join, oracles, packing, quality, repair, sharding, substring, topk, trie
from docspark.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(oracles.JACCARD)
def op1_ngram_jaccard_join(spark, sf_dir):
    """Documents linked by 90 % of equal 3-word shingles, as components."""
    return ngram_join.join(table(spark, sf_dir, "documents"), 3, 90, 100)


@query(oracles.TOP_K)
def op7_bit_sliced_top_k(spark, sf_dir):
    """Five best inner products of every 50th vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(topk.build_index(vectors), vectors.filter("vec_id % 50 = 0"), 5)


@query(oracles.SHARDS)
def op10_jump_shards(spark, sf_dir):
    """All documents in shards 0 to 15 under the law ``key``."""


    return sharding.assign(table(spark, sf_dir, "documents"), 16).withColumn("law", F.lit("key"))


@query(oracles.SUBSTRINGS)
def op6_substring_dedup(spark, sf_dir):
    """All documents without the 50-word windows that an earlier document holds."""
    return substring.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(oracles.MIXTURE)
def op5_mixture(spark, sf_dir):
    """Words that the mixture of all sources takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).taken().withColumnRenamed("key", "doc_id")


@query(oracles.LINES)
def op3_line_dedup(spark, sf_dir):
    """All documents without the lines that an earlier line repeats, exactly or within one word edit."""
    return line_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op2_weighted_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprint.edited(table(spark, sf_dir, "documents"))


@query()
def op4_language_mixture(spark, sf_dir):
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    return language.predict(docs, language.fit(docs.filter("not held_out")), ["doc_id", "held_out"])


@query()
def op8_fourier_quality(spark, sf_dir):
    """Calibrated quality of every document, learned from the labels that are not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_length_buckets(spark, sf_dir):
    """All documents in batches of 16 optimal length buckets."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op11_byte_bpe(spark, sf_dir):
    """Token ids of every document, and what they decode to."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents"), tokenizer, ["doc_id"])
    found = bpe.decode(ids, tokenizer, ["doc_id", "ids"])
    n_tokens = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return found.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query(oracles.REPAIR)
def op12_structure_repair(spark, sf_dir):
    """All conversations after planted damage: their faults, the cheapest repair and what it gives."""
    rows = table(spark, sf_dir, "conversations")
    return repair.report(rows, repair.damage(rows))


@query(oracles.TRIE)
def op13_prefix_trie(spark, sf_dir):
    """The prefix trie of all conversations after each took the head of the first one of its twenty."""
    return trie.nodes(*trie.with_common_heads(trie.sequences(table(spark, sf_dir, "conversations"))))
