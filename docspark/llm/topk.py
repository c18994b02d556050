"""Exact top-k by inner product over a bit-sliced index.

Every component is quantised to floor(scale * x) as an integer. A block of the index keeps its rows in the order of their ids and,
for each attribute and binary digit, one bitmap over those rows. A query's score is the sum of its weights times the attributes,
so it is added up with bitmap arithmetic alone: each signed binary digit of a weight adds the attribute's bitmaps, shifted, and
carry-save adders (exclusive or, and majority) reduce the bitmaps of one place value to a single result slice. The best rows are then
selected from the most significant slice downward; rows that tie down to the last slice are taken by smaller id. Scores are exact.

Index blocks and blocks of queries meet in a grid of row groups and query groups of bounded size; each cell keeps the k best rows of
a query over all its blocks, so pairs never become rows.

Cases: null vectors, vectors with a null, NaN or infinite component, and rows without id take no part; a finite component whose integer does not
fit a long, or a score among the results that does not, stops the query; a query meets vectors of its own length only; rows with the query's id are its own and never
candidates; repeated rows of other ids are candidates one by one; a query row that is repeated is answered once; with fewer than k
candidates all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
BLOCKS_PER_GROUP = 8
QUERIES_PER_GROUP = 128
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vector: Column, scale: int) -> Column:
    """array<bigint> of floor(scale * x), or null where the vector takes no part."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when((scaled >= -(2.0**63)) & (scaled < 2.0**63), F.floor(scaled)).otherwise(F.raise_error("a component times the scale does not fit a long").cast("bigint"))

    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, whole))


def _bitmaps(values: np.ndarray, width: int) -> np.ndarray:
    """(attributes, digits, words) bitmaps of an (rows, attributes) matrix of unsigned integers."""
    rows, attributes = values.shape
    words = -(-rows // 64)
    out = np.zeros((attributes, width, words * 8), dtype=np.uint8)
    for digit in range(width):
        packed = np.packbits(((values >> np.uint64(digit)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, digit, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _block(ids: np.ndarray, values: np.ndarray) -> dict:
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = int(values.min()) if values.size else 0
    width = max(1, (int(values.max()) - low).bit_length()) if values.size else 1
    above = values.astype(np.uint64) - np.uint64(low % 2**64)
    return {"dim": values.shape[1], "low": low, "width": width, "ids": ids.tobytes(), "slices": _bitmaps(above, width).tobytes()}


_INDEX = pa.schema([("dim", pa.int32()), ("low", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("slices", pa.binary())])
_INDEX_SQL = "dim int, low bigint, width int, ids binary, slices binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("q")
        lengths = np.diff(vectors.offsets.to_numpy())
        flat, ids = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("id").to_numpy().astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            for at in range(0, len(rows), BLOCK_ROWS):
                part = rows[at : at + BLOCK_ROWS]
                yield pa.RecordBatch.from_pylist([_block(ids[part], flat[starts[part][:, None] + np.arange(dim)[None, :]])], schema=_INDEX)


def build_index(items: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Blocks of the bit-sliced index over all rows that take part; packed where the rows lie, without a shuffle."""
    rows = items.select(F.col(id).cast("bigint").alias("id"), quantised(F.col(vector), scale).alias("q"))
    return rows.filter(F.col("id").isNotNull() & F.col("q").isNotNull()).mapInArrow(_index, _INDEX_SQL)


def signed_digits(weight: int) -> list[tuple[int, int]]:
    """(place, sign) of a weight's signed binary digits, no two of them neighbours."""
    out, place = [], 0
    while weight:
        if weight & 1:
            sign = 2 - (weight & 3)
            out.append((place, sign))
            weight -= sign
        weight >>= 1
        place += 1
    return out


def add_slices(slices: np.ndarray, weights: np.ndarray, low: int) -> tuple[list[np.ndarray], int]:
    """Result slices from the least significant on, and what to take off their number to get the score."""
    attributes, width, words = slices.shape
    by_place: dict[tuple[int, int], list[int]] = {}
    for a, weight in enumerate(weights.tolist()):
        for place, sign in signed_digits(weight):
            by_place.setdefault((place, sign), []).append(a)
    columns: dict[int, list[np.ndarray]] = {}
    less = 0
    for (place, sign), found in by_place.items():
        planes = slices[found] if sign > 0 else ~slices[found]
        less += len(found) * (-low if sign > 0 else (1 << width) - 1 + low) << place
        for digit in range(width):
            columns.setdefault(place + digit, []).append(planes[:, digit])
    out: list[np.ndarray] = []
    place = 0
    while place <= max(columns, default=-1):
        x = np.concatenate(columns[place]) if place in columns else np.zeros((1, words), np.uint64)
        while len(x) > 1:
            if len(x) == 2:
                carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
            else:
                third = len(x) // 3
                a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                half = a ^ b
                carry = (a & b) | (c & half)
                x = np.concatenate((half ^ c, x[3 * third :]))
            columns.setdefault(place + 1, []).append(carry)
        out.append(x[0])
        place += 1
    return out, less


def select_top(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows (ascending) of the k largest numbers among the allowed ones; of equal numbers the first rows."""
    sure, open_ = np.zeros_like(allowed), allowed
    for plane in reversed(slices):
        high = open_ & plane
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            open_ = high
        else:
            sure, open_ = sure | high, open_ & ~plane
            if n == k:
                open_ = np.zeros_like(allowed)
                break
    taken = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: max(0, k - len(taken))]
    return np.concatenate((taken, ties))


def _best_of(ids: np.ndarray, slices: np.ndarray, low: int, query: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    allowed = np.full(slices.shape[2] if slices.size else -(-len(ids) // 64), _FULL)
    if len(ids) % 64:
        allowed[-1] = np.uint64((1 << (len(ids) % 64)) - 1)
    for own in range(*np.searchsorted(ids, [query, query + 1])):
        allowed[own // 64] &= ~np.uint64(1 << (own % 64))
    result, less = add_slices(slices, weights, low) if slices.size else ([], 0)
    rows = select_top(result, allowed, k)
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    return [(sum(int(p[w] >> b & np.uint64(1)) << i for i, p in enumerate(result)) - less, int(ids[r])) for r, w, b in zip(rows, word, bit)]


def _cell(k: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        blocks = [
            (np.frombuffer(b["ids"], np.int64), np.frombuffer(b["slices"], np.uint64).reshape(b["dim"], b["width"], -1) if b["dim"] else np.zeros((0, 0, 0), np.uint64), b["low"])
            for b in index.select(["dim", "low", "width", "ids", "slices"]).to_pylist()
        ]
        out: list[tuple[int, int, int, int]] = []
        for q in asked.select(["query_id", "mark", "q"]).to_pylist():
            found = [x for ids, slices, low in blocks for x in _best_of(ids, slices, low, q["query_id"], np.array(q["q"], np.int64), k)]
            found.sort(key=lambda x: (-x[0], x[1]))
            out += [(q["query_id"], q["mark"], vec, score) for score, vec in found[:k]]
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.int64()] * 3 + [pa.decimal128(38, 0)]
        return pa.table([pa.array([Decimal(x) for x in c] if kind == kinds[3] else c, kind) for c, kind in zip(columns, kinds)], names=["query_id", "mark", "vec_id", "score"])

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the index with the highest inner product for every query row."""
    asked = queries.select(F.col(id).cast("bigint").alias("query_id"), quantised(F.col(vector), scale).alias("q"))
    asked = asked.filter(F.col("query_id").isNotNull() & F.col("q").isNotNull()).distinct()
    n_blocks, n_asked = index.count(), asked.count()
    rows, columns = max(1, -(-n_blocks // BLOCKS_PER_GROUP)), max(1, -(-n_asked // QUERIES_PER_GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("r", F.pmod(F.xxhash64("ids", "low"), F.lit(rows)).cast("int")).withColumn("c", every(columns))
    right = asked.select(
        F.size("q").alias("dim"), "query_id", F.xxhash64("q").alias("mark"), "q", F.pmod(F.xxhash64("query_id", "q"), F.lit(columns)).cast("int").alias("c"),
    ).withColumn("r", every(rows))
    best = left.groupBy("dim", "r", "c").cogroup(right.groupBy("dim", "r", "c")).applyInArrow(_cell(k), "query_id bigint, mark bigint, vec_id bigint, score decimal(38,0)")
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    fits = F.col("score").between(F.lit(Decimal(-(2**63))), F.lit(Decimal(2**63 - 1)))
    score = F.when(fits, F.col("score").cast("bigint")).otherwise(F.raise_error("a score does not fit a long").cast("bigint"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
