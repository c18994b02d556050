"""Document fingerprints by consistent weighted sampling.

A document's weighted terms are its word pairs (with marks for its start and end; long words count as several) and how often they occur; a term is
a hash below TERMS, so texts of any length have next to no two pairs in one term. For every term and sample, r and c are gamma(2, 1) and b uniform
variables made of a hash of both. With t = floor(ln(weight) / r + b), a sample is the (term, t) of smallest ln(c) - r (t - b) - r. Two documents agree
in a sample with a probability that equals their generalised Jaccard similarity, sum of minima over sum of maxima of the weights. A fingerprint
holds SAMPLES samples as 4 hex digits each; likeness is the share of equal ones.

r, b and c come from three independent exponential variables x, y and z: c = x + y, r = ln(c / x) + z, b = z / r. A term of weight 1 has t = 0
and the value ln(x), so of such terms the one of smallest hash is taken without a logarithm. Terms are taken STEP at a time, so memory does not
follow the length of a text times the samples.

``edited`` also fingerprints each text with its last quarter replaced by the start of the next document. Documents are dealt out in ranges of their ids that
hold each next document too: a range's bounds come from the ids alone, the first document of a range is sent to the range before it as well, so
texts are shuffled once and no task sees more than a range.

Cases: a null text is the empty text; an empty or blank text has no terms and the fingerprint of as many dashes, which is alike to itself and to nothing else;
null ids come first, equal ids follow each other in the order of their texts; one document is its own next; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.words import mix, multipliers, pieces, words

SAMPLES = 64
TERMS = 1 << 62
STEP = 1 << 10
LONG_WORD = 24
_LEAST = -(2**63)


def variables(samples: int, seed: int) -> np.ndarray:
    """Odd multipliers of the hashes that x, y and z are made of, (3, samples)."""
    return multipliers(3 * samples, seed).reshape(3, samples)


_PAIR = multipliers(2, 17)
_EDGE = np.array([0x1234567], np.uint64)


def _cut_long(column: pa.Array) -> pa.Array:
    """Texts with blanks put into words of over LONG_WORD characters, so that an edit in such a word leaves the rest of it alike."""
    if not pc.any(pc.match_substring_regex(column, rf"[^\s]{{{LONG_WORD + 1},}}")).as_py():
        return column
    return pc.replace_substring_regex(column, rf"([^\s]{{{LONG_WORD}}})", r"\1 ")


def term_weights(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and weights of each text."""
    found = words(_cut_long(column))
    out = []
    for a, b in zip(found.at[:-1].tolist(), found.at[1:].tolist()):
        if a == b:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        row = np.concatenate((_EDGE, found.hashes[a:b], _EDGE))
        terms = mix(row[:-1] * _PAIR[0] + row[1:] * _PAIR[1]) & np.uint64(TERMS - 1)
        out.append(np.unique(terms, return_counts=True))
    return out


def _hashes(terms: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hash of each sample and term, (samples, terms)."""
    x = terms[None, :] * keys[:, None]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x


def _exponential(hashes: np.ndarray) -> np.ndarray:
    """Exponential variables that grow with the hashes."""
    return -np.log1p(-((hashes >> np.uint64(11)) + 0.5) * 2.0**-53)


def sample(terms: np.ndarray, weights: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """16 bits for each sample of a non-empty document."""
    rows = np.arange(tables.shape[1])
    best_term, best_t, best = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    terms = terms.astype(np.uint64)
    single = terms[weights == 1]
    if len(single):
        least = np.full(len(rows), np.uint64(2**64 - 1))
        for i in range(0, len(single), STEP):
            part = single[i : i + STEP]
            hashes = _hashes(part, tables[0])
            at = hashes.argmin(axis=1)
            own = hashes[rows, at]
            less = own <= least
            best_term, least = np.where(less, part[at], best_term), np.where(less, own, least)
        best = np.log(_exponential(least))
    more = weights > 1
    if more.any():
        terms, logs = terms[more], np.log(weights[more])
        for i in range(0, len(terms), STEP):
            part, log = terms[i : i + STEP], logs[i : i + STEP]
            x, y, z = (_exponential(_hashes(part, keys)) for keys in tables)
            c = x + y
            r = np.log(c / x) + z
            b = z / r
            t = np.floor(log / r + b)
            values = np.log(c) - r * (t - b) - r
            at = values.argmin(axis=1)
            own = values[rows, at]
            less = own < best
            best_term, best_t, best = np.where(less, part[at], best_term), np.where(less, t[rows, at].astype(np.int64), best_t), np.where(less, own, best)
    return (mix(best_term * np.uint64(0x9E3779B97F4A7C15) + best_t.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2")


def fingerprints(column: pa.Array, samples: int, seed: int) -> list[str]:
    tables = variables(samples, seed)
    return [sample(t, w, tables).tobytes().hex() if len(t) else "-" * (4 * samples) for t, w in term_weights(column)]


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints."""
    same = np.frombuffer(a.encode(), np.uint32) == np.frombuffer(b.encode(), np.uint32)
    return float(same.mean())


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """id, fingerprint of every row, made where the row lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            column = batch.column("text").fill_null("")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(column, samples, seed), pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id]}, fingerprint string").withColumnRenamed("id", id)


def _edited_rows(samples: int, seed: int):
    """Rows come sorted by range, id and text; the last row of a range is its guest, the first document of the next range."""

    def finish(held: list[tuple[int, int, str]]) -> pa.RecordBatch:
        own, after = held[:-1], [h[2] for h in held[1:]]
        texts = [h[2] for h in held]
        edited = []
        for (_, _, text), following in zip(own, after):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + following[:cut])
        prints = fingerprints(pa.array(texts, pa.string()), samples, seed)
        changed = fingerprints(pa.array(edited, pa.string()), samples, seed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[1] for h in own], pa.int64()), pa.array([len(h[2]) for h in own], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array(prints[:-1], pa.string()), pa.array(changed, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(prints, changed)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        for batch in pieces(batches, "text"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "id", "text"))):
                if held and held[-1][0] != row[0]:
                    if len(held) > 1:
                        yield finish(held)
                    held = []
                held.append(row)
            if len(held) > 1:
                yield finish(held)
                held = held[-1:]

    return run


def _range_of(id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are not above the id, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    numbers = lambda xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
    blocks = F.size(F.filter(numbers(cuts[::step]), lambda c: c <= id))
    inside = F.size(F.filter(F.slice(numbers(cuts), (blocks - 1) * step + 1, F.lit(step)), lambda c: c <= id))
    return F.when(blocks == 0, 0).otherwise((blocks - 1) * step + inside)


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(_LEAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    placed = rows.withColumn("range", _range_of(F.col("id"), sorted({int(b) for b in bounds})))
    first = {r["range"]: r["id"] for r in placed.groupBy("range").agg(F.min("id").alias("id")).collect()}
    held = sorted(first)
    hosts = spark.createDataFrame([(first[r], before) for r, before in zip(held, held[-1:] + held[:-1])], "id bigint, host int")
    heads = placed.join(F.broadcast(hosts), "id").groupBy("id", "host").agg(F.min("text").alias("text"))
    own, guests = placed.select("range", F.lit(False).alias("guest"), "id", "text"), heads.select(F.col("host").alias("range"), F.lit(True).alias("guest"), "id", "text")
    sorted_rows = own.union(guests).repartition("range").sortWithinPartitions("range", "guest", "id", "text").select("range", "id", "text")
    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = sorted_rows.mapInArrow(_edited_rows(samples, seed), schema)
    return out.withColumn("id", F.when(F.col("id") != _LEAST, F.col("id"))).withColumnRenamed("id", id)
