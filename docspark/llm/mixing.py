"""Mixing sources to target weights: token blocks drawn per output shard, with DataFrame functions only.

*Targets.* Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by weight. A target stops at ``most`` times the
source's size; what is over is shared again by weight until no target is above.
*Blocks.* The words of a source form one stream, its documents in the order of their ids' md5, packed into blocks of ``block`` words; the last block
may be short. Places in the stream come from counts of cells (ranges of the md5), so no task sees a whole source.
*Slots.* A source fills as many slots as its target needs: each pass over the source takes every block once, the last pass ends with a slot that
is cut to the words still missing. Every slot draws its output shard by a hash, which makes the source counts of the shards multinomial draws,
given that each source meets its target. A pass maps slot numbers to blocks through an index permutation of its own (a j + b modulo the
number of blocks, a a prime that does not divide it), and blocks meet the documents' pieces in a join on (source, block).

Everything depends on the hashes of ids alone, so reruns agree. A pass takes a document at most once, and there are at most ``most`` passes.

Cases: a null or blank text has size 0 and is not taken; a source of size 0 has target 0; null ids are the id "null"; repeated rows are separate documents with
neighbouring places; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.scratch import settle

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1024
ROWS_PER_CELL = 5000
SLOTS_PER_SHARD = 4096
SLOTS_PER_CHUNK = 65536
WEIGHTS = (5, 2, 1)
PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121)


def draw(text: Column) -> Column:
    """First 32 bits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """s (number from 0 in code-point order, null last), source, source_size, target of a table of sources and their sizes.

    Sources are numbered in ranges. The shared level is found by sums over the sources, a few rounds of them.
    """
    ranged = sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id())
    ranged = settle(ranged)
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("range").orderBy(F.asc_nulls_last("source")))
    numbered = ranged.withColumn("nth", nth).join(offsets, "range").withColumn("s", F.col("before") + F.col("nth") - 1)
    cases = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("s") % len(weights) + 1).cast("int"))
    known = settle(numbered.select("s", "source", "source_size", cases.cast("bigint").alias("weight"), (F.col("source_size") * most).alias("cap")))
    all_words, level, full = known.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        at_cap = F.col("cap") <= F.lit(level) * F.col("weight")
        sums = known.agg(F.count(F.when(at_cap, 1)).alias("n"), F.sum(F.when(at_cap, F.col("cap"))).alias("cap"), F.sum(F.when(~at_cap, F.col("weight"))).alias("open")).first()
        if sums["n"] == full or not sums["open"]:
            break
        full, level = sums["n"], (all_words - (sums["cap"] or 0)) / sums["open"]
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return known.select("s", "source", "source_size", F.round(target, 6).alias("target"))


@dataclass
class Mix:
    """documents: key, mark, size, source_size, target, s, start (its place in the stream); slots: s, pass, block, take, shard."""

    documents: DataFrame
    slots: DataFrame
    block: int

    def spans(self) -> DataFrame:
        """The pieces that slots take of documents: key, mark, s, start, pass, shard, first and last (words of the document, last excluded)."""
        n = self.block
        pieces = self.documents.filter("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n)))
        )
        met = pieces.join(self.slots, ["s", "block"])
        base = F.col("block") * n
        low = F.greatest(base, "start") - F.col("start")
        high = F.least(base + F.col("take"), F.col("start") + F.col("size")) - F.col("start")
        return met.select("key", "mark", "s", "start", "pass", "shard", low.alias("first"), high.alias("last")).filter("first < last")

    def taken(self) -> DataFrame:
        """key, size, source_size, target, taken of every document."""
        words = self.spans().groupBy("s", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
        some = self.documents.filter("size > 0").join(words, ["s", "start"], "left")
        none = self.documents.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
        columns = ["key", "size", "source_size", "target"]
        return some.select(*columns, F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")).union(none.select(*columns, "taken"))

    def shard_counts(self) -> DataFrame:
        """shard, s, n: how many slots of each source an output shard drew."""
        return self.slots.groupBy("shard", "s").agg(F.count("*").alias("n"))


def _slots(sources: DataFrame, block: int) -> DataFrame:
    """Every slot with its pass, block, words and output shard."""
    size, want = F.col("source_size"), F.round("target").cast("bigint")
    whole, each = F.floor(size / block), F.ceil(size / block)
    passes, rest = F.floor(want / size), want % size
    per_source = sources.filter("source_size > 0").select(
        "s", "source_size", whole.alias("whole"), each.alias("each"), passes.alias("passes"), rest.alias("rest"),
        (passes * each + F.ceil(rest / block)).alias("n"),
    ).filter("n > 0")
    all_slots = per_source.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-all_slots // SLOTS_PER_SHARD))
    chunk = per_source.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SLOTS_PER_CHUNK)))).repartition("s", "chunk")
    first = F.col("chunk") * SLOTS_PER_CHUNK
    rows = chunk.withColumn("g", F.explode(F.sequence(first, F.least(first + SLOTS_PER_CHUNK, "n") - 1)))
    rows = rows.withColumn("pass", F.floor(F.col("g") / F.col("each"))).withColumn("j", F.col("g") % F.col("each"))
    primes = [F.lit(p).cast("bigint") for p in PRIMES]
    factor = F.coalesce(*(F.when(F.col("whole") % p != 0, p) for p in primes))
    shift = draw(F.concat_ws(":", F.lit("block"), "s", "pass"))
    moved = F.when(F.col("j") < F.col("whole"), (factor * F.col("j") + shift) % F.col("whole")).otherwise(F.col("j"))
    left = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest")) - F.col("j") * block
    shard = F.shiftright(draw(F.concat_ws(":", F.lit("shard"), "s", "g")) * F.lit(shards), 32)
    return rows.select("s", "pass", moved.alias("block"), F.least(F.lit(block).cast("bigint"), left).alias("take"), shard.alias("shard"))


def mixed_texts(docs: DataFrame, plan: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixture as rows of ``docs``: one row for every pass that takes words of a document.

    A pass that takes a document as a whole has its text as it is, else the words taken, joined by a space. The columns of ``docs`` stay, ``key`` repeats.
    Rows that repeat with id and text are told apart by their place only and share one of their rows' other columns.
    """
    piece = F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__pieces")
    taken = plan.spans().groupBy("key", "mark", "s", "start", "pass").agg(piece, F.sum(F.col("last") - F.col("first")).alias("__n"))
    sizes = plan.documents.select("s", "start", F.col("size").alias("__size")).filter("__size > 0")
    taken = taken.join(sizes, ["s", "start"]).select(F.col("key").alias("__key"), F.col("mark").alias("__mark"), "__pieces", "__n", "__size")
    once = docs.withColumn("__mark", F.xxhash64(F.col(text))).dropDuplicates([key, "__mark"])
    met = once.join(taken, once["__mark"].eqNullSafe(taken["__mark"]) & once[key].eqNullSafe(taken["__key"])).drop("__mark", "__key")
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    cut = F.flatten(F.transform("__pieces", lambda p: F.slice("__words", (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int"))))
    some = F.when(F.col("__n") < F.col("__size"), F.array_join(cut, " ")).otherwise(F.col(text))
    partial = met.withColumn("__words", F.when(F.col("__n") < F.col("__size"), words))
    return partial.withColumn(text, some).select(*docs.columns)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> Mix:
    """Plan of the mixture of all documents."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = settle(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw(name).alias("spot"), F.xxhash64(F.col(text)).alias("mark"),
    ))
    sources = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    cells = max(1, -(-rows.count() // ROWS_PER_CELL))
    known = F.col("a.source").eqNullSafe(F.col("b.source"))
    placed = rows.alias("a").join(sources.alias("b"), known).select("key", "mark", "size", "spot", "s", "source_size", "target", F.shiftright(F.col("spot") * F.lit(cells), 32).alias("cell"))
    before = W.partitionBy("s").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("s", "cell").agg(F.sum("size").alias("words")).select("s", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("s", "cell").orderBy("spot", "key", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    at = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["s", "cell"])
    documents = settle(at.select("key", "mark", "size", "source_size", "target", "s", (F.col("before") + F.col("inside")).alias("start")))
    return Mix(documents, _slots(sources, block), block)
