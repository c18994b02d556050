"""Quality classifier: kernel ridge regression on document statistics through random Fourier features, then isotonic calibration.

1. One scan turns every whole text into STATISTICS numbers (sizes, repetition, symbols, digits, case, word and line lengths, shares of short words).
2. They are standardised by means and deviations over all rows. cos(w x + b) with normal w and uniform b approximates a Gaussian kernel.
3. Every task adds up its part of the normal equations; Spark sums the parts by cell, and FEATURES^2 / 2 numbers go to the driver, which solves the
   ridge equations. All labelled rows to learn from are used.
4. Raw scores of those rows are counted in BINS bins, and pooling adjacent violators over the bins gives the calibration, monotone in the raw score.

Cases: null and empty texts have statistics 0 and are scored like any other; a null id is not held out and has no label; several labels of an id all count;
repeated rows count and are scored one by one; labels other than 0 and 1 and null are ignored; with nothing to learn from every score is 0.5; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.words import pieces, words
from docspark.llm.scratch import settle

STATISTICS = 20
FEATURES = 256
RIDGE = 1e-3
WIDTH = 4.0
BINS = 2000
_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 48) & (_BYTES <= 57),  # digits
    (_BYTES >= 65) & (_BYTES <= 90),  # upper case
    np.isin(_BYTES, list(b".,;:!?'\"()-")),  # punctuation
    np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),  # symbols
    _BYTES >= 128,  # other than ASCII
    _BYTES == 10,  # line ends
    np.isin(_BYTES, list(b".!?")),  # sentence ends
]).T.astype(np.float64)


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, STATISTICS) numbers of the texts."""
    found = words(column)
    size, n = np.diff(found.offsets).astype(float), np.diff(found.at).astype(float)
    kinds = np.stack([_per_text(_CLASSES[:, c][found.data], found.offsets) for c in range(_CLASSES.shape[1])], axis=1)
    long = (found.ends - found.starts).astype(float)
    text = np.repeat(np.arange(len(found)), np.diff(found.at))
    same = np.zeros(len(text))
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (text[1:] == text[:-1])
    symbol = _CLASSES[:, 3][found.data]
    in_word = np.cumsum(np.append(0.0, symbol))
    marked = (in_word[found.ends] > in_word[found.starts]).astype(float)
    last_mark = symbol[found.ends - 1] if len(text) else np.zeros(0)
    bare = ((in_word[found.ends] - in_word[found.starts]) == long).astype(float)
    by_word = _per_text(np.stack([long, long**2, same, marked, last_mark, bare, long <= 3, long >= 12], axis=1), found.at)
    distinct, most = np.zeros(len(found)), np.zeros(len(found))
    for i, (a, b) in enumerate(zip(found.at[:-1].tolist(), found.at[1:].tolist())):
        if b > a:
            counts = np.unique(found.hashes[a:b], return_counts=True)[1]
            distinct[i], most[i] = len(counts), counts.max()
    chars, tokens = np.maximum(size, 1), np.maximum(n, 1)
    mean = by_word[:, 0] / tokens
    out = np.column_stack([
        np.log1p(n), np.log1p(size), kinds[:, :5] / chars[:, None], np.log1p(kinds[:, 5]), n / (kinds[:, 5] + 1) / 50, kinds[:, 6] / tokens,
        mean / 5, np.sqrt(np.maximum(by_word[:, 1] / tokens - mean**2, 0)) / 5, by_word[:, 2:] / tokens[:, None], distinct / tokens, most / tokens,
    ])
    return out.astype(np.float32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        found = statistics(batch.column("text"))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), STATISTICS).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), flat], names=["id", "x"])


def describe(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, x of every row."""
    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(_describe, "id bigint, x array<float>")


@dataclass
class Classifier:
    """Raw score: features(x) @ weights; score: the calibration's value there."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.deviation @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack((z, np.ones(len(z))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        calibrated = np.interp(raw, self.steps, self.values) if len(self.steps) else np.full(len(raw), 0.5)
        return np.clip(0.999 * calibrated + 0.001 * np.clip(raw, 0, 1), 0, 1) if len(self.steps) else calibrated


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, STATISTICS).astype(np.float64)


def _equations(model: Classifier):
    """Sums of this task: upper triangle of features' products, and products with the label, as (cell, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        products, rows = np.zeros((d, d + 1)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = model.features(_matrix(part))
                products += z.T @ np.column_stack((z, part.column("label").to_numpy().astype(np.float64)))
                rows += part.num_rows
        if rows:
            cells = np.flatnonzero(np.triu(np.ones((d, d + 1), bool)).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(products.ravel()[cells])], names=["cell", "value"])

    return run


def pooled(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Isotonic means of bins (ascending) with these counts and sums, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, s in zip(counts.tolist(), sums.tolist()):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / n) for n, s, k in blocks]) if blocks else np.zeros(0)


def fit(described: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", seed: int = 5) -> Classifier:
    """The classifier of all labelled rows; ``described`` (id, x) gives the scale, ``labels`` the rows to learn from."""
    spark = described.sparkSession
    moments = described.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, deviation = np.zeros(STATISTICS), np.ones(STATISTICS)
    for row in moments:
        mean[row["i"]], deviation[row["i"]] = row["m"], row["s"] or 1.0
    rng = np.random.default_rng(seed)
    model = Classifier(mean, deviation, rng.standard_normal((STATISTICS, FEATURES)) / WIDTH, rng.random(FEATURES) * 2 * np.pi, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    known = labels.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    train = settle(described.join(known, "id").select("x", "label"))
    summed = train.mapInArrow(_equations(model), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    if not summed.num_rows:
        return model
    d = FEATURES + 1
    table = np.zeros(d * (d + 1))
    table[summed["cell"].to_numpy()] = summed["value"].to_numpy()
    upper = table.reshape(d, d + 1)
    gram = upper[:, :d] + np.triu(upper[:, :d], 1).T
    model.weights = np.linalg.solve(gram + RIDGE * gram[-1, -1] / d * np.eye(d), upper[:, d])
    shared = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(shared.value.raw(_matrix(batch)), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(((raw + 0.5) * BINS / 2).astype(np.int32)), batch.column("label")], names=["bin", "label"])

    counted = train.mapInArrow(bins, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("s")).orderBy("bin").toArrow()
    model.steps = (counted["bin"].to_numpy() + 0.5) * 2 / BINS - 0.5
    model.values = pooled(counted["n"].to_numpy(), counted["s"].to_numpy())
    return model


def score(described: DataFrame, model: Classifier) -> DataFrame:
    """id, score of every row."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(_matrix(batch)))], names=["id", "score"])

    return described.mapInArrow(run, "id bigint, score double")


def held_out(id: Column) -> Column:
    """Documents kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """id, held_out, score, predicted of every row, learned from the labels that are not held out."""
    described = settle(describe(docs, id, text))
    model = fit(described, labels.filter(~held_out(F.col(id))), id, label)
    scored = score(described, model)
    return scored.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
