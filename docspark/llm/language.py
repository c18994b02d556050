"""Language ID by multilingual mixture inference.

A language's model is a smoothed distribution of byte trigrams inside words (lower-cased, words bounded by blanks), counted over all documents to
learn from. A word's likelihood in a language is the product of its trigrams' probabilities. A document is a mixture: expectation-maximisation
estimates the share of its words that each language explains. The set of languages is chosen by penalised likelihood: the largest languages of the
mixture of all are fitted anew as sets of 1, 2, ..., and another language stays only if it raises the log-likelihood by more than
PENALTY + ln(words) / 2. The prediction is the largest language of the chosen set, its score the share.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when there is nothing to learn from; rows without a language or
text are not learned from; a null id is not held out; repeated rows count and are predicted one by one; of equal shares the first language in code-point order
wins; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.words import Words, pieces, words

BUCKETS = 1 << 15
SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 12
PIECE = 1 << 20


@dataclass
class Model:
    """Languages in code-point order and the log-probability of each trigram bucket in each, (buckets, languages)."""

    languages: list[str]
    logs: np.ndarray


def _trigrams(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the bucket of the trigram around each byte of a word, and where each word's trigrams begin."""
    found = words(pc.utf8_lower(pc.fill_null(column, "")))
    lengths = found.ends - found.starts
    begin = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(begin - found.starts, lengths)
    data = np.concatenate((found.data, np.array([32], np.uint8))).astype(np.uint32)
    before, after = data[at - 1], data[at + 1]
    before[begin] = 32
    after[begin + lengths - 1] = 32
    code = (before << np.uint32(16)) | (data[at] << np.uint32(8)) | after
    return found, ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64), begin


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in this task."""
    totals: dict[str, np.ndarray] = {}
    for batch in pieces(batches, "text", PIECE):
        found, grams, begin = _trigrams(batch.column("text"))
        begin = np.append(begin, len(grams))[found.at]
        languages = np.array(batch.column("lang").to_pylist(), dtype=object)
        for language in set(languages.tolist()):
            mine = np.zeros(len(found), np.int8)
            mine[languages == language] = 1
            held = np.bincount(grams[np.repeat(mine, np.diff(begin)) == 1], minlength=BUCKETS)
            totals[language] = totals[language] + held if language in totals else held
    for language, held in totals.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows that have a language and a text. Counts are summed in Spark; one number per language and bucket goes to the driver."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    summed = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = pc.unique(summed["lang"]).to_pylist()
    languages = sorted(found)
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    if languages:
        column = pc.index_in(summed["lang"], pa.array(languages)).to_numpy()
        counts[summed["bucket"].to_numpy(), column] += summed["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Column sums of the rows at[i]:at[i + 1]."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def mixtures(weights: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents, languages) by expectation-maximisation, and the log-likelihood of each document.

    weights: likelihood of each word in each language, up to a factor per word; at: where a document's words begin; allowed: the languages that
    may have a share. Documents that one language explains almost fully leave the rounds early.
    """
    n = np.diff(at)
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    open_ = np.flatnonzero(n > 0)
    for round_ in range(ROUNDS):
        rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in open_]) if len(open_) < len(n) and len(open_) else np.arange(at[-1] if len(open_) else 0)
        counts = n[open_] if len(open_) < len(n) else n
        own = np.repeat(shares[open_] if len(open_) < len(n) else shares, counts, axis=0)
        part = weights[rows] * own
        part /= part.sum(axis=1, keepdims=True)
        new = _sums(part, np.concatenate(([0], np.cumsum(counts)))) / np.maximum(counts, 1)[:, None]
        if len(open_) < len(n):
            shares[open_] = new
        else:
            shares[open_] = new[open_]
        if round_ in (2, 5, 8):
            open_ = open_[shares[open_].max(axis=1) < 0.995]
        if not len(open_):
            break
    likely = _sums(np.log((weights * np.repeat(shares, n, axis=0)).sum(axis=1, keepdims=True) + 1e-300), at)[:, 0]
    return shares, likely


def infer(logs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of the chosen languages (documents, languages) from each word's log-likelihoods; at: where a document's words begin."""
    n = np.diff(at)
    weights = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -80))
    every = np.ones((len(n), logs.shape[1]))
    all_shares, _ = mixtures(weights, at, every)
    order = np.argsort(-all_shares, axis=1, kind="stable")
    singles = _sums(np.log(weights), at)
    best = singles.argmax(axis=1)
    shares = np.zeros_like(all_shares)
    shares[np.arange(len(n)), best] = 1
    likely = singles[np.arange(len(n)), best]
    open_ = np.flatnonzero((n > 1) & (all_shares.max(axis=1) < 1 - 0.5 / np.maximum(n, 1)))
    for size in range(2, logs.shape[1] + 1):
        if not len(open_):
            break
        rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in open_])
        allowed = np.zeros((len(open_), logs.shape[1]))
        np.put_along_axis(allowed, order[open_][:, :size], 1, axis=1)
        new, better = mixtures(weights[rows], np.concatenate(([0], np.cumsum(n[open_]))), allowed)
        keep = better > likely[open_] + PENALTY + np.log(n[open_]) / 2
        shares[open_[keep]], likely[open_[keep]] = new[keep], better[keep]
        open_ = open_[keep]
    return shares


def fits(logs: np.ndarray, lengths: np.ndarray, shares: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-likelihood per trigram of each document's mixture, less that of a background where all trigram buckets are alike."""
    most = logs.max(axis=1)
    mixed = (np.exp(np.maximum(logs - most[:, None], -80)) * np.repeat(shares, np.diff(at), axis=0)).sum(axis=1) + 1e-300
    sums = _sums(np.stack((np.log(mixed) + most, lengths), axis=1), at)
    return sums[:, 0] / np.maximum(sums[:, 1], 1) + np.log(BUCKETS)


def _predict(model, fitted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = model.value.languages, model.value.logs
        for batch in pieces(batches, "text", PIECE * 4 // max(4, len(languages))):
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            found, grams, begin = _trigrams(text)
            if languages and len(grams):
                total = np.zeros((len(grams) + 1, len(languages)))
                np.cumsum(logs[grams], axis=0, out=total[1:])
                of_words = total[np.append(begin[1:], len(grams))] - total[begin]
                shares = infer(of_words, found.at)
                fit_of = fits(of_words, np.diff(np.append(begin, len(grams))), shares, found.at) if fitted else None
            else:
                shares = np.zeros((len(found), max(1, len(languages))))
                fit_of = np.zeros(len(found))
            known = letters & (shares.max(axis=1) > 0)
            best = shares.argmax(axis=1)
            names = [languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
            top = np.where(known, np.clip(shares[np.arange(len(best)), best], 0, 1), 0.0)
            mixed = [",".join(f"{languages[i]}:{row[i]:.3f}" for i in np.argsort(-row, kind="stable") if row[i] >= 0.0005) if k else "" for row, k in zip(shares, known.tolist())]
            more = [pa.array(fit_of, pa.float64())] if fitted else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(mixed, pa.string()), *more],
                names=["row", "lang_pred", "score", "languages", *(["fit"] if fitted else [])],
            )

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", fitted: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score and languages (the shares of the chosen set), predicted from the text alone.

    ``fitted`` adds fit, see ``fits``: below 0 the trigrams are less likely in the learned languages than at random.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*(F.col(c) for c in keep)).alias("row")
    rows = docs.select(row, F.col(text).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, languages string" + (", fit double" if fitted else "")
    return rows.mapInArrow(_predict(shared, fitted), schema).select("row.*", "lang_pred", "score", "languages", *(["fit"] if fitted else []))


def held_out(id: Column) -> Column:
    """Documents kept from learning: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
