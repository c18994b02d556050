"""Substring matching without theta joins.

Needles are looked for by one automaton (``needles.found``), whatever their number. Of several words that must all occur, only the rarest one
proposes candidates; the others are checked in their texts. So a common word never becomes a row for each chunk that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.tokens import distinct_words, words
from docspark.operators.needles import found
from docspark.session import settle


def contains_join(haystacks: DataFrame, needles: DataFrame) -> DataFrame:
    """(hay, needle) for every distinct ``hay`` string that contains a distinct ``needle`` string."""
    return found(haystacks.select("hay").distinct(), "hay", needles, ["hay"])


def containing_all(rows: DataFrame, key: str, hay: str, asked: DataFrame) -> DataFrame:
    """(ask, key) for every row (key, hay) whose string contains all ``words`` of an ask (ask, words), at least one of them.

    Words are counted in a first pass, whose hits are summed where they are found; in a second one only the rarest word of each ask proposes rows.
    """
    asked = settle(asked.select("ask", "words"))
    each = asked.select("ask", F.explode("words").alias("needle"))
    counts = found(rows, hay, each, [key]).groupBy("needle").agg(F.count("*").alias("n"))
    first = settle(_rarest(each, counts, "ask"))
    keep = list(dict.fromkeys((key, hay)))
    met = first.join(found(rows, hay, first, keep), "needle").join(asked, "ask")
    return met.filter(F.forall("words", lambda w: F.contains(F.col(hay), w))).select("ask", key)


def _rarest(each: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key and its rarest needle of the rows (key, needle); keys with a needle that does not occur have no row. ``counts``: needle, n."""
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "needle")
    least = each.join(counts, "needle", "left").groupBy(key).agg(F.min(order).alias("least"))
    return least.filter("least.n > 0").select(key, "least.needle")


def label_matches(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(needle, chunk_id): label in ``article_no``, but 제N조 never inside 제N조의M."""
    found = contains_join(chunks.select(F.col("article_no").alias("hay")), labels)
    # An occurrence that runs on into 의N belongs to another article: cut such tails off together with their head.
    whole = F.regexp_replace("hay", r"제\d+조의\d+", "\u0001")
    found = found.filter(~F.regexp_like("needle", F.lit(r"^제\d+조$")) | F.contains(whole, F.col("needle")))
    return found.join(chunks.select("chunk_id", F.col("article_no").alias("hay")), "hay").select("needle", "chunk_id")


def chunk_words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, words): the distinct words of every chunk text, as they are written. Kept like this, a chunk's id is written and read once."""
    return chunks.select("chunk_id", distinct_words(F.col("text")).alias("words"))


def listed(words: DataFrame) -> DataFrame:
    """(chunk_id, word) of (chunk_id, words)."""
    return words.select("chunk_id", F.explode_outer("words").alias("word")).filter("word is not null")


def word_index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, word): the distinct words of every chunk text, as they are written."""
    return listed(chunk_words(chunks))


def vocabulary(index: DataFrame) -> DataFrame:
    """(word, n): in how many chunks of a word index each word occurs."""
    return index.groupBy("word").agg(F.count("*").alias("n"))


def phrase_tokens(phrase: Column) -> Column:
    return F.array_distinct(F.filter(F.split(phrase, r"\s+"), lambda t: t != ""))


def phrase_matches(chunks: DataFrame, index: DataFrame, phrases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(phrase, chunk_id): the text contains every whitespace-separated token of the phrase.

    The words inside the tokens are looked for in the vocabulary ``known`` (word, n; by default counted from the index). The word that the fewest
    chunks can hold proposes the chunks, by way of the index; all tokens are then looked up in the text of these. A phrase that is one word needs no look-up.
    """
    asked = phrases.select("phrase").distinct().withColumn("tokens", phrase_tokens(F.col("phrase")))
    asked = settle(asked.withColumn("pieces", F.array_distinct(F.flatten(F.transform("tokens", words)))))
    each = asked.select("phrase", F.explode("pieces").alias("needle"))
    inside = settle(found(vocabulary(index) if known is None else known, "word", each, ["word", "n"]))
    first = settle(_rarest(each, inside.groupBy("needle").agg(F.sum("n").alias("n")), "phrase"))
    wanted = inside.join(first.select("needle").distinct(), "needle").select("needle", "word")
    places = settle(index.join(wanted, "word").select("needle", "chunk_id").distinct())  # two branches read them, the index is read once
    proposed = first.join(places, "needle").join(asked, "phrase")
    sure = (F.size("tokens") == 1) & (F.get("tokens", F.lit(0)) == F.col("needle"))
    checked = (
        proposed.filter(~sure).select("phrase", "tokens", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id")
        .filter(F.forall("tokens", lambda t: F.contains("text", t))).select("phrase", "chunk_id")
    )
    out = proposed.filter(sure).select("phrase", "chunk_id").unionByName(checked)
    wordless = asked.filter((F.size("pieces") == 0) & (F.size("tokens") > 0))
    return out if wordless.isEmpty() else out.unionByName(wordless_matches(chunks, wordless))


def wordless_matches(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, chunk_id) for phrases (phrase, tokens) without a single word in them, such as marks and signs: looked for in the texts themselves."""
    asked = phrases.select(F.col("phrase").alias("ask"), F.col("tokens").alias("words"))
    return containing_all(chunks, "chunk_id", "text", asked).withColumnRenamed("ask", "phrase")
