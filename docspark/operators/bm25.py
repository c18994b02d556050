"""BM25 over chunk rows: an index sharded by chunk, and batch search for a table of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions import tokens as T
from docspark.operators.blocks import Best
from docspark.session import settle

BROADCAST_BYTES = 32 * 1024 * 1024
ROW_BYTES = 64
ITEM_BLOCK = 2048
QUESTION_BLOCK = 512
QUESTION_BLOCKS_HELD = 64
ROUNDING = 1e-6


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per chunk: doc_len and its distinct terms with their counts."""
    return chunks.select("chunk_id", T.counted_tokens(T.chunk_text()).alias("counted")).select("chunk_id", "counted.*")


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len."""
    return index.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def term_stats(index: DataFrame) -> DataFrame:
    """term, df (chunks with the term) and idf over a written index."""
    per_term = index.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return with_idf(per_term, index.count())


def with_idf(per_term: DataFrame, n: int) -> DataFrame:
    """term, df, idf of terms (term, df) of ``n`` chunks; negative values become a share of the mean over all terms."""
    df = settle(per_term.select("term", "df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select(
        "term", "df", F.when(F.col("raw") < 0, mean * P.BM25_EPSILON).otherwise(F.col("raw")).alias("idf")
    )


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """chunk_id, doc_len, term, tf, df, idf: a row for every chunk and term of it.

    The most frequent terms, as many as measure under BROADCAST_BYTES, are sent to the chunks; only postings of the others are shuffled.
    """
    posted = index.select("chunk_id", F.col("doc_len").cast("bigint").alias("doc_len"), F.explode("terms").alias("t"))
    posted = posted.select("chunk_id", "doc_len", F.col("t.term").alias("term"), F.col("t.tf").cast("bigint").alias("tf"))
    known, digits = terms.select("term", "df", "idf"), F.length(F.bin("df"))
    classes = known.groupBy(digits.alias("digits")).agg((F.count("*") * ROW_BYTES + F.sum(F.length("term")) * 4).alias("size")).collect()
    size, least = 0, None
    for row in sorted(classes, reverse=True):
        size += row["size"]
        if size > BROADCAST_BYTES:
            break
        least = row["digits"]
    if least is None:
        return posted.join(known, "term")
    frequent, rare = known.filter(digits >= least), known.filter(digits < least)
    met = posted.join(F.broadcast(frequent), "term")
    if size <= BROADCAST_BYTES:
        return met
    return met.unionByName(posted.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(rare, "term"))


def _pack_asked(asked: DataFrame, blocks: int) -> DataFrame:
    """Questions in blocks: parallel lists of question, term and weight."""
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int")
    entries = F.collect_list(F.struct(F.col("question_id").cast("string").alias("asked"), "term", "weight"))
    packed = asked.groupBy(block.alias("block")).agg(entries.alias("e"))
    return packed.select("block", F.col("e.asked").alias("asked"), F.col("e.term").alias("term"), F.col("e.weight").alias("weight"))


def _pack_index(known: Broadcast | None, mean_len: float):
    """Neighbouring chunks of a partition as one row of parallel lists: ids, number of terms, terms and gains.

    ``known``: the asked terms, where they are few enough to be sent along; other terms, and chunks without a known one, add nothing to a score and stay behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if known is None else known.value
        for batch in batches:
            for at in range(0, batch.num_rows, ITEM_BLOCK):
                part = batch.slice(at, ITEM_BLOCK)
                ids, lists = part.column("chunk_id"), part.column("terms")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                entries = lists.flatten()
                terms, times = entries.field("term"), entries.field("tf").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                if asked is not None:
                    kept = pc.is_in(terms, value_set=asked)
                    terms, kept = terms.filter(kept), kept.to_numpy(zero_copy_only=False)
                    row, times = row[kept], times[kept]
                norm = P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * part.column("doc_len").to_numpy(zero_copy_only=False) / mean_len)
                gains = times * (P.BM25_K1 + 1) / (times + norm[row])
                sizes = np.bincount(row, minlength=part.num_rows)
                some = sizes > 0
                lists = [ids.filter(pa.array(some)), pa.array(sizes[some].astype(np.int32)), terms, pa.array(gains)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in lists], names=["ids", "sizes", "terms", "gains"])

    return run


class _Asked:
    """A block of questions, taken apart once per task: its distinct terms, and for each question the places of its terms and their weights."""

    def __init__(self, terms: pa.Array, asked: pa.Array, weights: np.ndarray):
        self.known = terms.unique()
        at = pc.index_in(terms, self.known).to_numpy(zero_copy_only=False)
        names = asked.dictionary_encode()
        of = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(names.dictionary) + 1))
        self.questions = [(q, at[order[a:b]], weights[order[a:b]]) for q, a, b in zip(names.dictionary.to_pylist(), cuts, cuts[1:])]


def _scored(k: int, prune: bool = True, counts: dict[str, int] | None = None):
    """Scores of blocks of chunks against blocks of questions, by sums over the terms both hold; k rows per question and task.

    The largest gain of each term in a block bounds the scores there: a question whose bound is below its k-th best score so far passes the block by
    (``prune``). ``counts`` takes how many blocks were scored and skipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, blocks = Best(k), {}
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("block")[row].as_py()
                if number not in blocks:
                    if len(blocks) >= QUESTION_BLOCKS_HELD:
                        blocks.clear()
                    terms, names, weights = (batch.column(c)[row].values for c in ("term", "asked", "weight"))
                    blocks[number] = _Asked(terms, names, weights.to_numpy(zero_copy_only=False))
                asked = blocks[number]
                ids = np.array(batch.column("ids")[row].as_py(), dtype=object)
                sizes = batch.column("sizes")[row].values.to_numpy(zero_copy_only=False)
                gains = batch.column("gains")[row].values.to_numpy(zero_copy_only=False)
                at = pc.index_in(batch.column("terms")[row].values, asked.known).fill_null(-1).to_numpy(zero_copy_only=False)
                chunk, hit = np.repeat(np.arange(len(ids)), sizes), at >= 0
                order = np.argsort(at[hit], kind="stable")
                chunk, gain, term = chunk[hit][order], gains[hit][order], at[hit][order]
                start = np.searchsorted(term, np.arange(len(asked.known) + 1))
                top, held = np.zeros(len(asked.known)), start[1:] > start[:-1]
                if held.any():
                    top[held] = np.maximum.reduceat(gain, start[:-1][held])
                for question, places, weights in asked.questions:
                    bound = float((np.maximum(weights, 0) * top[places]).sum())
                    skip = bound <= 0 or (prune and bound + ROUNDING < best.floor(question))
                    if counts is not None:
                        counts["skipped" if skip else "scored"] = counts.get("skipped" if skip else "scored", 0) + 1
                    if skip:
                        continue
                    score = np.zeros(len(ids))
                    for place, weight in zip(places.tolist(), weights.tolist()):
                        a, b = start[place], start[place + 1]
                        score[chunk[a:b]] += weight * gain[a:b]
                    score = np.round(score, 6)
                    found = np.flatnonzero(score > 0)
                    if len(found):
                        best.add(question, ids[found], score[found])
                if best.full:
                    yield best.hand_out()
        yield best.hand_out()

    return run


def search(index: DataFrame, terms: DataFrame, questions: DataFrame, top_n: int = P.RRF_CANDIDATES, text: str = "question") -> DataFrame:
    """question_id, chunk_id, score, rank for the texts in ``text``; a repeated question token counts as often as it is asked.

    A blocked top-k: chunks are packed where they lie, each with all its terms that are asked for, so the index is not shuffled. Questions come in
    blocks of about QUESTION_BLOCK; a task scores its chunks against a block and hands on ``top_n`` rows per question, so no
    (question, chunk) pair becomes a row; a block that cannot reach a question's k-th best score so far is passed by. Question blocks are broadcast while the asked terms' measured size is under
    BROADCAST_BYTES, beyond that the blocks meet in a salted equi-join.
    """
    spark = index.sparkSession
    asked = settle(
        questions.select("question_id", F.explode(T.index_tokens(F.col(text))).alias("term"))
        .groupBy("question_id", "term").agg(F.count("*").alias("times"))
        .join(terms.select("term", "idf"), "term")
        .select("question_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    )
    size = asked.agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("q"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["q"] // QUESTION_BLOCK))
    packed_asked = _pack_asked(asked, blocks)
    mean_len = index.agg(F.avg("doc_len")).first()[0] or 1.0
    few = size["n"] * ROW_BYTES + size["chars"] * 4 <= BROADCAST_BYTES
    known = spark.sparkContext.broadcast(pa.array([r["term"] for r in asked.select("term").distinct().collect()], pa.string())) if few else None
    rows = index.select("chunk_id", "doc_len", "terms")
    packed = rows.mapInArrow(_pack_index(known, mean_len), "ids array<string>, sizes array<int>, terms array<string>, gains array<double>")
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if few:
        met = packed.join(F.broadcast(packed_asked), "block")
    else:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salted = packed_asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).join(salted, ["block", "salt"])
    columns = ["block", "ids", "sizes", "terms", "gains", "asked", "term", "weight"]
    best = met.select(*columns).mapInArrow(_scored(top_n), "asked string, chunk_id string, score double")
    kind = questions.schema["question_id"].dataType
    scores = best.select(F.col("asked").cast(kind).alias("question_id"), "chunk_id", "score")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
