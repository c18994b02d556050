"""Substring dedup: words covered by a window whose word sequence also starts in an earlier document are removed.

1. Rabin-Karp hashes of all runs of ANCHOR words are rolled over every text, and each window of ``length`` words is named by the
   smallest of the runs inside it. Equal windows have equal names. Neighbouring windows mostly share theirs: a stretch of windows with one name is
   one row, with a Rabin-Karp hash of all its words.
2. The names are counted in Spark. Only a window with a name that occurs in two documents can repeat. Where all stretches of a name are equal, their
   windows repeat as they stand, and the stretches of later documents are repeated windows.
3. Where stretches of a name differ, each window of them gets two Rabin-Karp hashes, which are counted in Spark by the smallest document id, and
   those that start in a later document are joined back.
4. A document's repeated windows merge into maximal intervals, which go.

The names of steps 2 and 3 travel to the scans as bitmaps of bounded size, whose false positives the counts remove. Texts with no such window
are finished in the scan and do not move.

Cases: a null or blank text has no words; with fewer than ``length`` words nothing is removed; windows repeated inside one document
stay; rows that share an id are one document and do not remove from each other, each row is judged and returned by itself; rows with
a null id come before all others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import bitmap
from docspark.llm.scratch import settle, settle_wide
from docspark.llm.words import Words, inverse, mix, pieces, powers, words

LENGTH = 50
ANCHOR = 16
_BASES = (0xD1342543DE82EF95 | 3, 0xAF251AF3B0F025B5 | 3)
_LEAST = -(2**63)


def rolling(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of the ``length`` words from each position on."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * powers(inverse(base), n)[: n - length + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values from each position on."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _windows(found: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (in the piece) of the windows inside one text, the text of each, and its name."""
    counts = np.maximum(np.diff(found.at) - length + 1, 0)
    text = np.repeat(np.arange(len(found)), counts)
    before = np.cumsum(counts) - counts
    at = np.arange(len(text)) - before[text] + found.at[:-1][text]
    names = sliding_min(rolling(found.hashes, anchor, _BASES[0]), length - anchor + 1)
    return at, text, names[at] if len(at) else np.zeros(0, np.uint64)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def _stretches(found: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First position (in the piece), number of windows, text and name of every run of neighbouring windows with one name."""
    at, text, names = _windows(found, length, anchor)
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), text[first], names[first]


def _span_hashes(hashes: np.ndarray, at: np.ndarray, n: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of n words from each position on."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    return mix((sums[at + n] - sums[at]) * powers(inverse(base), len(hashes) + 1)[at] + n.astype(np.uint64))


def _names(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = words(batch.column("text"))
            at, n, text, names = _stretches(found, length, anchor)
            spans = _span_hashes(found.hashes, at, n + length - 1, _BASES[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.view(np.int64)), pa.array(spans.view(np.int64)), pa.array(_ids(batch)[text]), pa.array(_marks(found)[text]),
                    pa.array((at - found.at[:-1][text]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ],
                names=["name", "span", "id", "mark", "start", "n"],
            )

    return run


def _marks(found: Words) -> np.ndarray:
    """32-bit hash of each text's word sequence, to tell rows with equal ids apart."""
    sums = np.zeros(len(found.hashes) + 1, np.uint64)
    n = np.diff(found.at)
    place = np.arange(len(found.hashes)) - np.repeat(found.at[:-1], n)
    np.cumsum(mix(found.hashes + mix(place.astype(np.uint64) + np.uint64(1))), out=sums[1:])
    return (mix(sums[found.at[1:]] - sums[found.at[:-1]] + n.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _repeats(length: int, anchor: int, mixed):
    """The windows of stretches that may differ under one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = words(batch.column("text"))
            at, text, names = _windows(found, length, anchor)
            hit = bitmap.holds(mixed.value, names)
            at, text = at[hit], text[hit]
            h1, h2 = (rolling(found.hashes, length, b)[at] if len(at) else np.zeros(0, np.uint64) for b in _BASES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(_ids(batch)[text]),
                    pa.array(_marks(found)[text]), pa.array((at - found.at[:-1][text]).astype(np.int32)),
                ],
                names=["h1", "h2", "id", "mark", "start"],
            )

    return run


def _kept(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def _base(length: int, anchor: int, shared):
    """Size and, where no window can repeat, the finished row of every text; the other texts travel on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            column = batch.column("text")
            found = words(column)
            _, _, text, names = _stretches(found, length, anchor)
            open_ = np.zeros(len(found), bool)
            open_[text[bitmap.holds(shared.value, names)]] = True
            raw = found.data.tobytes()
            lo, hi = found.offsets[:-1].tolist(), found.offsets[1:].tolist()
            shas = [None if o else _kept(b" ".join(raw[a:b].split())) for o, a, b in zip(open_.tolist(), lo, hi)]
            texts = [raw[a:b].decode() if o else None for o, a, b in zip(open_.tolist(), lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(_marks(found)), pa.array(np.diff(found.at)), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                names=["id", "mark", "n_words", "sha", "open_text"],
            )

    return run


def covered(n: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window from one of the starts, or of the ``counts`` positions from it, on."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + length - 1, -1)
    return np.cumsum(change[:n]) > 0


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for n, sha, text, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("n_words", "sha", "open_text", "starts", "counts"))):
                if text is None:
                    gone, kept = 0, None
                else:
                    out = covered(n, np.array(starts or [], np.int64), np.array(counts or [], np.int64), length)
                    gone, all_words = int(out.sum()), text.encode().split()
                    body = b" ".join(w for w, x in zip(all_words, out.tolist()) if not x)
                    sha, kept = _kept(body), body.decode()
                removed.append(gone)
                shas.append(sha)
                texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256", "changed_text"],
            )

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256, changed_text of every row.

    kept_sha256 is of the kept words, joined by a space; changed_text holds them where a window of the text may repeat, else null (the
    text as it is has all words).
    """
    anchor = min(ANCHOR, length)
    rows = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(_LEAST)).alias("id"), F.col(text).alias("text"))
    stretches = settle_wide(rows.mapInArrow(_names(length, anchor), "name bigint, span bigint, id bigint, mark int, start int, n int"))
    sides = (F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("span").alias("one"), F.max("span").alias("other"))
    shared = settle(stretches.groupBy("name").agg(*sides).filter("lo < hi").select("name", "lo", (F.col("one") != F.col("other")).alias("mixed")))
    later = stretches.join(shared.filter("not mixed"), "name").filter("id > lo").select("id", "mark", "start", "n")
    windows = rows.mapInArrow(_repeats(length, anchor, bitmap.build(shared.filter("mixed"), "name")), "h1 bigint, h2 int, id bigint, mark int, start int")
    windows = settle_wide(windows)
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi")
    single = windows.join(first, ["h1", "h2"]).filter("id > lo").select("id", "mark", "start", F.lit(1).alias("n"))
    gone = later.union(single).distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    base = rows.mapInArrow(_base(length, anchor, bitmap.build(shared, "name")), "id bigint, mark int, n_words bigint, sha string, open_text string")
    joined = base.join(gone, ["id", "mark"], "left").select("id", "n_words", "sha", "open_text", F.col("gone.start").alias("starts"), F.col("gone.n").alias("counts"))
    out = joined.mapInArrow(_finish(length), "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, changed_text string")
    return out.withColumn("id", F.when(F.col("id") != _LEAST, F.col("id"))).withColumnRenamed("id", id)
