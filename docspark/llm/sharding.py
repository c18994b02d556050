"""Sharding: jump consistent hashing maps stable keys to shards, with DataFrame functions only.

The k-th pseudorandom number of a key is the first 32 bits of md5("key:k"). A key jumps from shard b to
floor((b + 1) * 2^32 / (number + 1)) until it would leave the last shard, so a key's shard for n + 1 shards is its shard for n
or the new one. No ring table and no state is needed.

Cases: a null key is the key "null"; a null text has 0 bytes and the checksum of the empty text; rows with equal keys share a
shard and take neighbouring slots in the order of checksum and size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_CELL = 5000
MOST_JUMPS = 256


def _draw(text: Column) -> Column:
    """First 32 bits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def jumps(key: Column, shards: int) -> Column:
    """struct(at, next): the key's shard among ``shards``, and where it would jump from there.

    A key makes one jump per step and ln(shards) jumps on average; shards bounds their number, and over MOST_JUMPS of them
    do not occur (a probability under 1e-80 for a million shards).
    """
    text = key_text(key)

    def step(state: Column, k: Column) -> Column:
        onward = F.floor((state["next"] + 1) * F.lit(4294967296.0) / (_draw(F.concat(text, F.lit(":"), k.cast("string"))) + 1))
        moved = F.struct(state["next"].alias("at"), onward.cast("bigint").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step)


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard of every row.

    size: UTF-8 bytes plus 1; slot: gapless from 0 inside the shard, in the order of the key's md5; grown_shard: the shard once
    one more is appended. Texts stay where they are: only numbers are shuffled. Slots are counted in cells, ranges of the
    md5 that hold about ROWS_PER_CELL rows of a shard, and the cells' counts are summed up, so no task sorts a whole shard.
    """
    cells = max(1, -(-docs.count() // (shards * ROWS_PER_CELL)))
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("key"), (F.octet_length(body).cast("bigint") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        jumps(F.col(key), shards).alias("jump"), _draw(key_text(F.col(key))).alias("spot"),
    ).select(
        "key", "size", "text_crc32", "spot", F.col("jump.at").cast("int").alias("shard"),
        F.when(F.col("jump.next") == shards, F.lit(shards)).otherwise(F.col("jump.at")).cast("int").alias("grown_shard"),
        F.shiftright(F.col("spot") * F.lit(cells), 32).alias("cell"),
    )
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("shard", "cell").orderBy("spot", "key", "text_crc32", "size")
    return (
        placed.withColumn("nth", F.row_number().over(inside)).join(offsets, ["shard", "cell"])
        .select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write the rows as Parquet, one folder per shard, spread over several files where a shard is large."""
    docs.withColumn("shard", jumps(F.col(key), shards)["at"].cast("int")).write.partitionBy("shard").parquet(path)
