"""Token columns for the inverted index.

Words are normalised in Arrow batches, and a worker keeps what it made of a word: a corpus holds each word many times.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import profiles as P

LONG_PARTICLE = "^(.{2,}?)(?:" + "|".join(P.INDEX_LONG_PARTICLES) + ")$"
SHORT_PARTICLE = "^(.{%d,})[%s]$" % (P.INDEX_SHORT_PARTICLE_MIN_LEN - 1, "".join(P.INDEX_SHORT_PARTICLES))


_LONG, _SHORT = re.compile(LONG_PARTICLE), re.compile(SHORT_PARTICLE)
WORD = re.compile(P.TOKEN_SEPARATOR.replace("[^", "[", 1))
KEPT_WORDS = 1 << 18


def words(text: Column) -> Column:
    """Runs of Hangul, ASCII letters and digits."""
    return F.array_remove(F.split(text, P.TOKEN_SEPARATOR), "")


def normal(word: str) -> str:
    """A Latin word in lower case, a Korean one (with a letter that is not ASCII) without one particle."""
    if word.isascii():
        return word.lower()
    shorter = _LONG.sub(r"\1", word)
    return shorter if shorter != word else _SHORT.sub(r"\1", word)


class _Kept(dict):
    """What ``make`` gives for each of the latest KEPT_WORDS words at most."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= KEPT_WORDS:
            self.clear()
        made = self[word] = self.make(word)
        return made


NORMAL = _Kept(normal)
HASHES = _Kept(lambda token: int.from_bytes(hashlib.md5(token.encode()).digest()[:2], "big"))


def _tokens(text: str | None) -> list[str]:
    return _normalised(WORD.findall(text or ""))


def _normalised(found: list[str]) -> list[str]:
    return [token for word in found if len(token := NORMAL[word]) >= 2]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    """Sequences as a list column, null for None; the items are converted in one go."""
    ends = np.cumsum([0, *(len(r) if r is not None else 0 for r in rows)], dtype=np.int32)
    items = pa.array(list(chain.from_iterable(r for r in rows if r is not None)), kind)
    return pa.ListArray.from_arrays(pa.array(ends), items, mask=pa.array([r is None for r in rows], pa.bool_()))


def _buckets(rows: list[list[str]], dim: int) -> pa.Array:
    """The hash bucket of every token of each text."""
    hashes = _lists([list(map(HASHES.__getitem__, tokens)) for tokens in rows], pa.int32())
    return pa.ListArray.from_arrays(hashes.offsets, pa.array(hashes.values.to_numpy() % np.int32(dim)))


def _counted(rows: list[list[str]]) -> list[pa.Array]:
    """doc_len and terms of the tokens of each text."""
    counts = [Counter(tokens) for tokens in rows]
    terms = [sorted(count) for count in counts]
    names = _lists(terms, pa.string())
    times = pa.array([n for count, names_ in zip(counts, terms) for n in map(count.__getitem__, names_)], pa.int32())
    entries = pa.StructArray.from_arrays([names.values, times], ["term", "tf"])
    return [pa.array(map(len, rows), pa.int32()), pa.ListArray.from_arrays(names.offsets, entries)]


def index_tokens(text: Column) -> Column:
    """Tokens of at least two characters: Latin ones in lower case, one Korean particle removed."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return _lists([_tokens(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def counted_tokens(text: Column) -> Column:
    """struct<doc_len, terms>: the number of tokens, and the distinct ones in order with their counts."""

    @F.arrow_udf("struct<doc_len:int,terms:array<struct<term:string,tf:int>>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_counted([_tokens(t) for t in texts.to_pylist()]), ["doc_len", "terms"])

    return run(text)


def token_buckets(text: Column, dim: int) -> Column:
    """The stable hash bucket of every token."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _buckets([_tokens(t) for t in texts.to_pylist()], dim)

    return run(text)


def distinct_words(text: Column) -> Column:
    """The distinct ``words`` of a text in the order of their first places; a null text has none, but null."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return _lists([None if t is None else dict.fromkeys(WORD.findall(t)) for t in texts.to_pylist()], pa.string())

    return run(text)


def indexed(text: Column, label: Column, dim: int) -> Column:
    """struct<doc_len, terms, buckets, words>: ``counted_tokens`` and ``token_buckets`` of text and label, ``distinct_words`` of the text, which is read once."""

    @F.arrow_udf("struct<doc_len:int,terms:array<struct<term:string,tf:int>>,buckets:array<int>,words:array<string>>")
    def run(texts: pa.Array, labels: pa.Array) -> pa.Array:
        tokens, words = [], []
        for text, label in zip(texts.to_pylist(), labels.to_pylist()):
            found = WORD.findall(text or "")
            words.append(None if text is None else dict.fromkeys(found))
            tokens.append(_normalised(found + WORD.findall(label or "")))
        made = [*_counted(tokens), _buckets(tokens, dim), _lists(words, pa.string())]
        return pa.StructArray.from_arrays(made, ["doc_len", "terms", "buckets", "words"])

    return run(text, label)


def chunk_text() -> Column:
    """What is indexed of a chunk row: body, label and title."""
    return F.concat_ws(" ", F.coalesce("text", F.lit("")), chunk_label())


def chunk_label() -> Column:
    return F.concat_ws(" ", F.coalesce("article_no", F.lit("")), F.coalesce("article_title", F.lit("")))


def chunk_tokens() -> Column:
    """Tokens of a chunk row."""
    return index_tokens(chunk_text())
