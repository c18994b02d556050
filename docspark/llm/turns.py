"""Places of rows in a sorted group, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.scratch import settle


def count_words(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def placed(rows: DataFrame, key: str, order: list[str], total: str | None = None) -> DataFrame:
    """The rows with place (from 1) inside their key in the order of the columns (nulls first), and cum, the sum of ``total`` up to and with the row.

    Rows are cut into ranges of (key, order), so a key that holds a third of all rows lies in many ranges. Places are counted inside a range; only the
    key that a range shares with the one before needs an offset, so offsets are one row per range at most and are broadcast. Keys may be null.
    The rows are written first, as cutting ranges reads them twice.
    """
    cut = settle(settle(rows).repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part", key).orderBy(*order)
    run = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    amount = F.col(total) if total else F.lit(0)
    local = cut.withColumn("place", F.row_number().over(inside).cast("bigint")).withColumn("cum", F.sum(amount).over(run))
    earlier = W.partitionBy("at_key").orderBy("at_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(F.col(key).alias("at_key"), F.col("part").alias("at_part")).agg(F.count("*").alias("n"), F.sum(amount).alias("s"))
    offsets = sizes.select("at_key", "at_part", F.sum("n").over(earlier).alias("rows_before"), F.sum("s").over(earlier).alias("sum_before")).filter("rows_before > 0")
    met = local.join(F.broadcast(settle(offsets)), (F.col("part") == F.col("at_part")) & F.col(key).eqNullSafe(F.col("at_key")), "left")
    return met.select(*rows.columns, (F.col("place") + F.coalesce("rows_before", F.lit(0))).alias("place"), (F.col("cum") + F.coalesce("sum_before", F.lit(0))).alias("cum"))
