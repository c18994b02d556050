"""Vectors: embedding, validation, joining and exact cosine top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import tokens as T
from docspark.operators.blocks import Best
from docspark.session import settle

DIM = 64
ITEM_BLOCK = 2048
QUESTION_BLOCK = 512
BROADCAST_BYTES = 64 * 1024 * 1024


def hashed_counts(rows: pd.Series) -> np.ndarray:
    """Default model: how many tokens fall into each hash bucket."""
    if not len(rows):
        return np.zeros((0, DIM), dtype=np.float32)
    held = np.concatenate(list(rows)).astype(np.int64)
    if len(held) and not 0 <= held.min() <= held.max() < DIM:
        raise ValueError(f"buckets {held.min()} to {held.max()}, there are {DIM}")
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return np.bincount(row * DIM + held, minlength=len(rows) * DIM).reshape(len(rows), DIM).astype(np.float32)


def embed(inputs: Column, encode: Callable[[pd.Series], np.ndarray] = hashed_counts, safe: bool = False) -> Column:
    """Vector column of ``inputs``; ``encode`` maps one Arrow batch of inputs to a matrix.

    ``safe``: where a batch fails, its inputs are tried one by one, and those that fail get no vector.
    """

    def encoded(batch: pd.Series) -> np.ndarray | list:
        try:
            return encode(batch)
        except Exception:
            if not safe:
                raise
            return [None] if len(batch) == 1 else [encoded(batch.iloc[i : i + 1].reset_index(drop=True))[0] for i in range(len(batch))]

    @F.arrow_udf("array<float>")
    def run(batch: pa.Array) -> pa.Array:
        made = encoded(batch.to_pandas()) if len(batch) else []
        if isinstance(made, np.ndarray) and made.ndim == 2:
            ends = np.arange(len(made) + 1, dtype=np.int32) * np.int32(made.shape[1])
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(made.astype(np.float32).ravel()))
        return pa.array([None if v is None else np.asarray(v, np.float32) for v in made], pa.list_(pa.float32()))

    return run(inputs)


def embed_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", embed(T.token_buckets(T.chunk_text(), DIM)).alias("embedding"))


def embed_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    return questions.withColumn("embedding", embed(T.token_buckets(F.col(text), DIM)))


def validate(embeddings: DataFrame, dim: int) -> DataFrame:
    """One row: total, wrong dimension, first offender, zero vectors."""
    wrong = F.size("embedding") != dim
    zero = F.forall("embedding", lambda x: x == 0)
    return embeddings.agg(
        F.count("*").alias("n_total"),
        F.coalesce(F.sum(wrong.cast("bigint")), F.lit(0)).alias("n_wrong_dim"),
        F.min(F.when(wrong, F.col("chunk_id"))).alias("first_wrong"),
        F.coalesce(F.sum(zero.cast("bigint")), F.lit(0)).alias("n_zero"),
    )


def join_embeddings(chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their vector, and the chunks that have none."""
    return chunks.join(embeddings, "chunk_id"), chunks.join(embeddings, "chunk_id", "left_anti")


def unit(vector: Column) -> Column:
    """Vector of doubles divided by its length; a zero vector stays zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.get(
        F.transform(F.array(norm), lambda n: F.transform(wide, lambda x: F.when(n == 0, 0.0).otherwise(x / n))),
        F.lit(0),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score_pairs(pairs: DataFrame, questions: DataFrame, items: DataFrame) -> DataFrame:
    """Cosine of given (question_id, chunk_id) pairs, rounded to 6 digits."""
    return (
        pairs.join(items.select("chunk_id", unit(F.col("embedding")).alias("item_vec")), "chunk_id")
        .join(questions.select("question_id", unit(F.col("embedding")).alias("question_vec")), "question_id")
        .withColumn("score", F.round(dot(F.col("question_vec"), F.col("item_vec")), 6))
        .drop("item_vec", "question_vec")
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a partition as one row with an id list and a flat vector list."""
    for batch in batches:
        for at in range(0, batch.num_rows, ITEM_BLOCK):
            part = batch.slice(at, ITEM_BLOCK)
            ids = part.column(0).to_pylist()
            lengths = pc.unique(pc.list_value_length(part.column(1)))
            if len(lengths) > 1:
                raise ValueError(f"vectors of lengths {sorted(lengths.to_pylist(), key=str)}: find them with validate()")
            flat = part.column(1).flatten().cast(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.string())), pa.array([flat.to_numpy()], pa.list_(pa.float64()))],
                names=["ids", "flat"],
            )


def _rows_normalised(flat: np.ndarray, n: int, dim: int) -> np.ndarray:
    """(n, dim) matrix of unit rows; a block with vectors of another length is an error, as scores would mix rows."""
    if len(flat) != n * dim:
        raise ValueError(f"{n} vectors hold {len(flat)} numbers, questions have {dim} each: find them with validate()")
    m = flat.reshape(n, dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best_of_block(k: int):
    """Scores of blocks of items against blocks of questions; a task hands on the k best items of every question it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.array(batch.column(0)[row].as_py(), dtype=object)
                asked = batch.column(2)[row].as_py()
                flat = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
                dim = len(flat) // len(asked)
                wanted = _rows_normalised(flat, len(asked), dim)
                items = _rows_normalised(batch.column(1)[row].values.to_numpy(zero_copy_only=False), len(ids), dim)
                scores = np.round(wanted @ items.T, 6)
                for j, question in enumerate(asked):
                    best.add(question, ids, scores[j])
                if best.full:
                    yield best.hand_out()
        yield best.hand_out()

    return run


def _flat(structs: Column) -> Column:
    return F.flatten(F.transform(structs, lambda s: F.transform(s["embedding"], lambda x: x.cast("double"))))


def _question_blocks(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Questions (keys, block, asked, embedding) as rows of id lists and flat vectors."""
    packed = questions.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("asked", "embedding"))).alias("q"))
    return packed.select(*keys, "block", F.col("q.asked").alias("asked"), _flat(F.col("q")).alias("wanted"))


def _best(met: DataFrame, k: int) -> DataFrame:
    """asked, chunk_id, score: the k best of every pair of blocks (ids, flat, asked, wanted)."""
    return met.select("ids", "flat", "asked", "wanted").mapInArrow(_best_of_block(k), "asked string, chunk_id string, score double")


def top_k(questions: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Exact k nearest items (chunk_id string, embedding) of every question (question_id bigint, embedding).

    A blocked matrix product: items are packed where they lie, questions in blocks of bounded size, and a task yields the k best
    rows of a question over all its blocks. Question blocks are broadcast while their measured size is under BROADCAST_BYTES;
    beyond that the blocks meet in a salted equi-join. Vectors of another length than the questions' stop the search with an error.
    """
    spark = questions.sparkSession
    size = questions.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    n_blocks = max(1, -(-n // QUESTION_BLOCK))
    block = F.pmod(F.xxhash64("question_id"), F.lit(n_blocks)).cast("int")
    blocks = _question_blocks(questions.select(block.alias("block"), F.col("question_id").cast("string").alias("asked"), "embedding"), [])
    packed = items.select("chunk_id", "embedding").mapInArrow(_pack, "ids array<string>, flat array<double>")
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if n * dim * 8 <= BROADCAST_BYTES:
        met = packed.join(F.broadcast(blocks), "block")
    else:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread_blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        packed = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
        met = packed.join(spread_blocks, ["block", "salt"])
    best = _best(met, k).withColumn("question_id", F.col("asked").cast("bigint")).drop("asked")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, embedding, sets) of a batch as blocks of one set each: set, ids, flat. About ITEM_BLOCK items are handed on at a time."""

    def made(blocks: list[tuple]) -> pa.RecordBatch:
        kinds = (("set", pa.int64()), ("ids", pa.list_(pa.string())), ("flat", pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.unique(pc.list_value_length(batch.column(1))).to_pylist()
        if len(lengths) > 1:
            raise ValueError(f"vectors of lengths {sorted(lengths, key=str)}: find them with validate()")
        vectors = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        ids, sets = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(sets).to_numpy(zero_copy_only=False))
        of = sets.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        row, (names, cuts) = row[order], np.unique(of[order], return_index=True)
        blocks, held = [], 0
        for name, a, b in zip(names.tolist(), cuts, [*cuts[1:], len(row)]):
            for at in range(a, b, ITEM_BLOCK):
                mine = row[at : min(at + ITEM_BLOCK, b)]
                blocks.append((name, ids[mine], vectors[mine].ravel()))
                held += len(mine)
                if held >= ITEM_BLOCK:
                    yield made(blocks)
                    blocks, held = [], 0
        if blocks:
            yield made(blocks)


def top_k_within(asked: DataFrame, members: DataFrame, items: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Exact k nearest members of a question's own set: asked, chunk_id, score, rank.

    ``asked``: keys, asked (a distinct string), embedding; ``members``: keys, chunk_id; ``items``: chunk_id, embedding. While the
    questions measure under BROADCAST_BYTES, every item meets the numbers of its sets once, and a task packs what it has of a set in
    blocks: a vector is shuffled once, however many sets hold its item. Beyond that a set is packed in blocks by the hash of its
    members, and its question blocks are sent to each of them. Pairs are scored inside the blocks without becoming rows.
    """
    counts = asked.groupBy(*keys).agg(F.count("*").alias("n"))
    blocked = asked.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("asked"), F.ceil(F.col("n") / QUESTION_BLOCK)))
    blocks = _question_blocks(blocked.drop("n"), keys)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if size["n"] * (size["dim"] or 0) * 8 <= BROADCAST_BYTES:
        named = settle(counts.select(*keys, F.monotonically_increasing_id().alias("set")))
        sets = members.join(named, keys).groupBy("chunk_id").agg(F.collect_list("set").alias("sets"))
        rows = items.select("chunk_id", "embedding").join(sets, "chunk_id").select("chunk_id", "embedding", "sets")
        packed = rows.mapInArrow(_pack_sets, "set bigint, ids array<string>, flat array<double>")
        met = packed.join(F.broadcast(blocks.join(named, keys).select("set", "asked", "wanted")), "set")
    else:
        sizes = members.groupBy(*keys).agg(F.ceil(F.count("*") / ITEM_BLOCK).alias("parts"))
        part = F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
        packed = members.join(sizes, keys).withColumn("part", part).join(items.select("chunk_id", "embedding"), "chunk_id").groupBy(*keys, "part").agg(
            F.collect_list(F.struct("chunk_id", "embedding")).alias("i")
        )
        packed = packed.select(*keys, "part", F.col("i.chunk_id").alias("ids"), _flat(F.col("i")).alias("flat"))
        blocks = blocks.join(sizes, keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        met = packed.join(blocks, [*keys, "part"])
    best = _best(met, k)
    order = W.partitionBy("asked").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
