"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is the sequence of its words. A line goes when an earlier line (by document id, then line number) has the same words, or, if both have
MIN_WORDS words at least, is one word edit away (a word replaced, inserted or left out). The earliest of such lines stays.

1. Every line is hashed where it lies; equal lines are reduced to their first occurrence.
2. One edit leaves either the first or the last half of a line untouched. Only lines that share such a half with another line can have a neighbour, and
   the shared half tells in which half the edit is.
3. Those lines emit all variants within the bound as hashed keys (length, position, words before, words after): with the word at a position left out,
   and, as the shorter line, as they are with a gap at a position. All lines with an equal variant are at most one edit apart, so each is
   paired with the earliest of them only: the pairs are as many as the variants, however large a group is.
4. The pairs' words are compared (edit distance at most 1), and the removed lines are cut out of their documents.

Variants hash words in runs of STRIDE with one hash for all before and one for all after, so a line of n words costs about n hashes.
Sets of hashes are broadcast as 2^20 masks of 64 bits at most; they only spare work, exact joins decide.

Cases: a null text stays null with no lines; blank lines always stay; rows with equal id and text are one document; rows with equal id and
different text are ordered by a hash of the text; rows with a null id come first; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.scratch import settle

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 8
STRIDE = 16
_LEAST = -(2**63)


def line_words(line: Column) -> Column:
    """Words between blanks (space, tab, line feed, vertical tab, form feed, carriage return)."""
    rare = "\t\n\x0b\x0c\r"
    odd = F.contains(line, F.lit(rare[0]))
    for blank in rare[1:]:
        odd = odd | F.contains(line, F.lit(blank))
    return F.array_remove(F.split(F.when(odd, F.translate(line, rare, "     ")).otherwise(line), " "), "")


def _halves(words: Column, n: Column) -> list[Column]:
    """Hashes of the first and last half, for the line as the longer (or equal) one of a pair and as the shorter one."""
    out = []
    for longer in (n, n + 1):
        half = F.floor((longer - 1) / 2).cast("int")
        first, last = (F.array_join(F.slice(words, at, half), " ") for at in (F.lit(1), n - half + 1))
        out += [F.xxhash64(longer, F.lit(0), first), F.xxhash64(longer, F.lit(1), last)]
    return out


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, mark, pos, line of every line."""
    return docs.select(
        F.coalesce(F.col(id).cast("bigint"), F.lit(_LEAST)).alias("id"), F.hash(F.col(text)).alias("mark"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")
    )


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, mark, pos, words, n of every line that has words."""
    words = _lines(docs, id, text).select("id", "mark", "pos", line_words(F.col("line")).alias("words"))
    return words.withColumn("n", F.size("words")).filter("n > 0")


def _hashed() -> list[Column]:
    """Name of a line: hashes of its words joined by blanks, as one string is hashed faster than many."""
    return [F.xxhash64("joined").alias("h1"), F.xxhash64(F.lit(1), "joined").alias("h2")]


def masks(hashes: DataFrame, column: str) -> DataFrame:
    """cell (20 bits of the hash) and the mask of its next 6 bits: at most 2^20 rows."""
    cell, bit = F.col(column).bitwiseAND(F.lit(0xFFFFF)), F.shiftright(F.col(column), 20).bitwiseAND(F.lit(63)).cast("int")
    one = F.expr("1L")
    spots = hashes.select(cell.alias("cell"), F.call_function("shiftleft", one, bit).alias("spot"))
    return spots.groupBy("cell").agg(F.bit_or("spot").alias("mask"))


def passing(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """The rows whose hash is in the masks (and few others)."""
    met = rows.withColumn("cell", F.col(column).bitwiseAND(F.lit(0xFFFFF))).join(F.broadcast(known), "cell")
    bit = F.shiftright(F.col(column), 20).bitwiseAND(F.lit(63)).cast("int")
    return met.filter(F.call_function("shiftright", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1).drop("cell", "mask")


def _variants(n: Column, side: Column, whole: Column) -> Column:
    """Keys of a line's variants, as the line that has a word more (or as many) or, for ``whole``, as the shorter one.

    side: 0 when the first half is shared (the edit is behind it), 1 when the last half is.
    """
    longer = F.when(whole, n + 1).otherwise(n)
    half = F.floor((longer - 1) / 2).cast("int")
    low, high = F.when(side == 0, half).otherwise(0), F.when(side == 0, longer - 1).otherwise(half - 1)
    skip = F.when(whole, 0).otherwise(1)

    def key(p: Column) -> Column:
        before, after = F.floor(p / STRIDE).cast("int"), F.floor((longer - 1 - p) / STRIDE).cast("int")
        left = F.slice("words", before * STRIDE + 1, p - before * STRIDE)
        right = F.slice("words", p + skip + 1, n - p - skip - after * STRIDE)
        return F.xxhash64(longer, p, F.element_at("heads", before + 1), left, F.element_at("tails", after + 1), right)

    return F.transform(F.sequence(low, high), key)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether word arrays a and b are at most one edit apart: after their common start, the rest is equal but for one word."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    start = F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1)
    rest = lambda x, skip: F.slice(x, start + 1 + skip, F.greatest(F.size(x) - start - skip, F.lit(0)))
    return F.when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1)).when(F.size(a) > F.size(b), rest(a, 1) == rest(b, 0)).otherwise(rest(a, 0) == rest(b, 1))


def _near(docs: DataFrame, distinct: DataFrame, id: str, text: str) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line one edit away."""
    long = distinct.filter(F.col("n") >= MIN_WORDS)
    sides = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("key")) for i in range(4)))
    keys = long.select("h1", "h2", F.explode(sides).alias("x")).select("h1", "h2", "x.kind", "x.key")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    open_ = passing(keys, masks(shared, "key"), "key").groupBy("h1", "h2").agg(F.collect_set("kind").alias("kinds"))
    open_ = open_.join(long.select("h1", "h2", "first"), ["h1", "h2"]).select("h1", "h2", "first", "kinds", F.xxhash64("first").alias("spot"))
    open_ = settle(open_)
    place = F.struct("id", "mark", "pos")
    rows = passing(_lines(docs, id, text).withColumn("spot", F.xxhash64(place)), masks(open_, "spot"), "spot")
    rows = rows.select(place.alias("first"), line_words(F.col("line")).alias("words")).withColumn("n", F.size("words"))
    lines = settle(rows.join(open_.drop("spot"), "first").dropDuplicates(["h1", "h2"]))
    runs = F.sequence(F.lit(0), F.floor(F.col("n") / STRIDE).cast("int"))
    heads = F.transform(runs, lambda q: F.xxhash64(F.slice("words", F.lit(1), q * STRIDE)))
    tails = F.transform(runs, lambda q: F.xxhash64(F.slice("words", F.col("n") - q * STRIDE + 1, q * STRIDE)))
    hashed = lines.select("first", "n", "words", heads.alias("heads"), tails.alias("tails"), F.explode("kinds").alias("kind"))
    variants = hashed.select("first", F.explode(_variants(F.col("n"), F.col("kind") % 2, F.col("kind") >= 2)).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("first").alias("hub"), F.max("first").alias("far")).filter("hub < far").drop("far")
    pairs = variants.join(least, "variant").filter("hub < first").select("first", "hub").distinct()
    hubs = lines.select(F.col("first").alias("hub"), F.col("words").alias("hub_words"))
    met = pairs.join(lines.select("first", "h1", "h2", "words"), "first").join(hubs, "hub")
    return met.filter(_one_edit(F.col("words"), F.col("hub_words"))).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark, removed: the line numbers that go, for every document that has some."""
    rows = _rows(docs, id, text)
    halves = [F.when(F.col("n") >= MIN_WORDS, h).alias(f"k{i}") for i, h in enumerate(_halves(F.col("words"), F.col("n")))]
    lines = settle(rows.withColumn("joined", F.array_join("words", " ")).select("id", "mark", "pos", "n", *_hashed(), *halves))
    place = F.struct("id", "mark", "pos")
    distinct = settle(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.min("n").alias("n"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))))
    near = _near(docs, distinct, id, text).withColumn("near", F.lit(True))
    known = distinct.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").filter("near or times > 1")
    gone = lines.select("h1", "h2", "id", "mark", "pos").join(known, ["h1", "h2"]).filter(F.col("near").isNotNull() | (F.col("first") < place))
    return gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("removed"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the text less its removed lines, and n_lines and n_removed (columns of these names are replaced)."""
    gone = removed_lines(docs, id, text).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__removed"))
    marked = docs.withColumn("__id", F.coalesce(F.col(id).cast("bigint"), F.lit(_LEAST))).withColumn("__mark", F.hash(F.col(text)))
    met = marked.join(gone, ["__id", "__mark"], "left")
    lines = F.when(F.col("__removed").isNotNull(), F.split(F.col(text), "\n"))
    n_lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed")))
    shorter = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    out = met.withColumn("__lines", lines).withColumn("n_lines", F.coalesce(n_lines, F.lit(0)).cast("bigint"))
    out = out.withColumn("n_removed", F.coalesce(F.when(F.col("__removed").isNotNull(), F.size("__removed")), F.lit(0)).cast("bigint"))
    out = out.withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(shorter))
    return out.drop("__id", "__mark", "__removed", "__lines")
