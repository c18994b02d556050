"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by joined vocabulary strings.

A text is cut at the vocabulary's added tokens, then into words by the usual pattern of byte-level vocabularies. The bytes of a word are a doubly linked
list of symbols; a priority queue holds the ranks of all neighbouring pairs that can merge. The best pair (ties: the leftmost) merges, its neighbours enter
the queue as new pairs, and entries whose symbols have changed meanwhile are skipped when they come up. So a word of n bytes costs n log n, whatever it holds.

Texts stay where they lie: no shuffle. The vocabulary file is read on the driver and broadcast; its size is that of the file, whatever the corpus. A worker
keeps the ids of up to 2 * KEPT short words it has met last. Memory follows the longest text's ids and, beyond that, its longest word.

The file's path is a parameter. It is the JSON form of the ``tokenizers`` library: a BPE model without unknown token, dropout or affixes, with byte-level
words and added tokens that are matched anywhere. Anything else is refused.

Cases: a null text is empty and has no ids; an added token's string in a text is that token; any other text, whatever its characters, comes back unchanged;
ids that do not form UTF-8 give U+FFFD; an id outside the vocabulary stops the job; rows stay one by one, repeated or not; an empty table gives no rows.
The kept columns go through as one struct, so their names cannot clash with the operator's own.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.words import pieces

KEPT = 1 << 18
KEPT_CHARS = 32
LONG_TEXT = 1 << 20
STEP = 1 << 16

# How byte-level vocabularies cut a text into words, and the letters and numbers of Unicode 17 and later, which the tables that such
# vocabularies go by do not hold.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def _ranges(codes: Iterable[int]) -> str:
    """Sorted character codes as the inside of a character class."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class _Patterns:
    """The word pattern: as explicit classes for texts of common characters (the fastest), as it is, and with later characters that are no letters."""

    def __init__(self):
        common = [*range(0x530), *range(0x2000, 0x2070)]
        letter, number, blank = (_ranges(c for c in common if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        self.uncommon = re.compile(f"[^{_ranges(common)}]")
        own = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\S", f"[^{blank}]")
        self.common = re.compile(own.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{blank}]"))
        later = "[" + "".join("-".join(f"\\U{int(c, 16):08x}" for c in part.split("-")) for part in LATER.split()) + "]"
        self.later = re.compile(later)
        other = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{later})")
        for kind in (r"\p{L}", r"\p{N}"):
            other = other.replace(rf" ?{kind}+", rf" ?(?:(?!{later}){kind})+")
        self.plain, self.strict = regex.compile(PATTERN), regex.compile(other)

    def of(self, text: str) -> re.Pattern | regex.Pattern:
        if not self.uncommon.search(text):
            return self.common
        return self.strict if self.later.search(text) else self.plain


_patterns = lru_cache(1)(_Patterns)


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte: printable bytes for themselves, the others by 256 and up, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary(dict):
    """Ids and merges of a vocabulary file. As a mapping: the packed ids (little-endian, 32 bits) of a word, made when first asked for."""

    def __init__(self, file: str):
        made = json.loads(file)
        model, words = made["model"], made["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
        if model.get("type", "BPE") != "BPE" or odd or not plain or made["normalizer"] or (made["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without normaliser, unknown token, dropout or affixes is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]):
            raise ValueError("added tokens must match anywhere and as they are")
        letters, vocab = _byte_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        strings = vocab | {t["content"]: t["id"] for t in made["added_tokens"]}
        self.strings = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            self.strings[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        self.older: dict[str, bytes] = {}
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in made["added_tokens"]}
        longest_first = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(longest_first) + ")") if self.added else None

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            ids = merge([self.of_byte[b] for b in word.encode()], self.ranks, self.merged)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        parts = self.added_pattern.split(text) if self.added_pattern else [text]
        return b"".join(self.added[p] if p in self.added else self._words(p) for p in parts if p)

    def _words(self, text: str) -> bytes:
        pattern = _patterns().of(text)
        if len(text) < LONG_TEXT:
            return b"".join(map(self.__getitem__, pattern.findall(text)))
        out, found = bytearray(), (m.group() for m in pattern.finditer(text))
        while step := list(islice(found, STEP)):
            out += b"".join(map(self.__getitem__, step))
        return bytes(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def merge(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """The symbols after all merges, best rank first, leftmost first among equal ranks.

    A queue entry is rank * 2^32 + place of the left symbol; it is stale unless ``pair`` still has that rank at that place.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [ranks.get(p, -1) for p in zip(symbols, symbols[1:])]
    pair.append(-1)
    queue = [rank << 32 | at for at, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        rank, at = entry >> 32, entry & 0xFFFFFFFF
        if pair[at] != rank:
            continue
        following = after[at]
        symbols[at] = new = merged[rank]
        symbols[following] = pair[following] = pair[at] = -1
        after[at] = onward = after[following]
        if onward < n:
            before[onward] = at
            pair[at] = found = ranks.get((new, symbols[onward]), -1)
            if found >= 0:
                heapq.heappush(queue, found << 32 | at)
        back = before[at]
        if back >= 0:
            pair[back] = found = ranks.get((symbols[back], new), -1)
            if found >= 0:
                heapq.heappush(queue, found << 32 | back)
    return [s for s in symbols if s >= 0]


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(file: str) -> Vocabulary:
    """The vocabulary of a file's content, made once per worker."""
    if file not in _loaded:
        _loaded.clear()
        _loaded[file] = Vocabulary(file)
    return _loaded[file]


def _shared(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    Vocabulary(file)  # a file of another kind is refused before any task starts
    return df.sparkSession.sparkContext.broadcast(file)


def _mapped(df: DataFrame, column: str, keep: list[str], tokenizer: str, out: str, kind: str, change) -> DataFrame:
    """The kept columns and one that ``change`` (vocabulary, value) makes of another."""
    shared = _shared(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in pieces(batches, "value"):
            values = [change(vocabulary, v.as_py()) for v in batch.column("value")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values, pa.string() if kind == "string" else pa.binary())], names=["row", out])

    rows = df.select(F.struct(*(F.col(c) for c in keep)).alias("row"), F.col(column).alias("value"))
    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {out} {kind}")
    return made.select("row.*", out)


def encode(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and ids: the token ids of its text, packed as little-endian unsigned 32-bit numbers."""
    return _mapped(docs, text, keep, tokenizer, "ids", "binary", lambda vocabulary, value: vocabulary.encode(value or ""))


def decode(rows: DataFrame, tokenizer: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of every row and decoded: the text of its packed ids; null ids give an empty text."""
    return _mapped(rows, ids, keep, tokenizer, "decoded", "string", lambda vocabulary, value: vocabulary.decode(value or b""))


def id_list(ids: bytes) -> list[int]:
    """Packed ids as numbers."""
    return np.frombuffer(ids, "<u4").tolist()
