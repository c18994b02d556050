"""Packing into optimal length buckets.

The lengths of all rows are counted in Spark. Dynamic programming over this histogram chooses the bucket bounds with the least padding: rows of a
bucket are padded to its bound. Inside a bucket rows form batches of floor(budget / bound) rows, one at least.

The histogram is exact: rows of m distinct lengths hold m * m / 2 words at least, so it has about 100,000 entries for 5 billion words. The bounds are the
optimum, and each is a length that rows have. Numbers inside a bucket come from counts of cells (ranges of the id's hash), so no task sees a whole bucket.

Cases: a null or blank text has length 0; all rows of length 0 have a bucket of bound 0 and form batches of ``budget`` rows; a row longer than the budget is a batch by
itself, whole; repeated rows are packed one by one; null ids have a hash like any other; fewer distinct lengths than buckets give fewer buckets; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.scratch import settle

WORD = r"[^\x20\x09-\x0D]+"
EXACT = 256
STEPS = 128
BUCKETS = 16
BUDGET = 16384
ROWS_PER_CELL = 5000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def step_up(length: Column) -> Column:
    """A coarser length (``pack`` takes lengths as they are): itself up to EXACT, else the next multiple of its power of 2 / STEPS."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - int(np.log2(STEPS)))
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("bigint"))


def choose_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket bounds, each one of the (ascending, distinct) lengths, with the least total of count * (bound - length).

    With n rows and s words in the first lengths, a bucket of the lengths i:j costs lengths[j - 1] * (n[j] - n[i]) - (s[j] - s[i]). Over j this is a line
    for every i, so a step finds the best i on the lower hull of the lines; a number of buckets takes time in proportion to the lengths, in whole numbers.
    """
    m, k = len(lengths), min(buckets, len(lengths))
    if not m:
        return []
    at = [int(x) for x in lengths]
    n, s = [0], [0]
    for length, count in zip(at, counts.tolist()):
        n.append(n[-1] + count)
        s.append(s[-1] + count * length)
    best: list[int | None] = [0] + [None] * m
    backs, totals = [], []
    for _ in range(k):
        new: list[int | None] = [None] * (m + 1)
        back = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height and i of the line height - slope * length
        first = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                x, y = n[j - 1], best[j - 1] + s[j - 1]
                while len(hull) - first >= 2 and (y - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]):
                    hull.pop()
                hull.append((x, y, j - 1))
            length = at[j - 1]
            while len(hull) - first >= 2 and hull[first + 1][1] - length * hull[first + 1][0] < hull[first][1] - length * hull[first][0]:
                first += 1
            if len(hull) > first:
                x, y, back[j] = hull[first]
                new[j] = y - length * x + length * n[j] - s[j]
        best = new
        backs.append(back)
        totals.append(best[m])
    least = min(t for t in totals if t is not None)
    out, j = [], m
    for back in reversed(backs[: totals.index(least) + 1]):
        out.append(at[j - 1])
        j = back[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, bucket (number from 0), bound, batch (number in the bucket), slot (place in the batch), padding of every row, and the columns ``keep``."""
    rows = settle(docs.select(F.col(id).alias("id"), *keep, word_count(F.col(text)).alias("n_words"), F.xxhash64(F.col(id), F.col(text)).alias("mark")))
    counted = rows.groupBy("n_words").agg(F.count("*").alias("n")).orderBy("n_words").toArrow()
    lengths, counts = counted["n_words"].to_numpy(), counted["n"].to_numpy()
    zero = [0] if len(lengths) and lengths[0] == 0 else []
    bounds = zero + choose_bounds(lengths[len(zero) :], counts[len(zero) :], buckets)
    cells = max(1, -(-int(counts.sum()) // ROWS_PER_CELL))
    all_bounds = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else F.array(F.lit(0).cast("bigint"))
    bucket = F.size(F.filter(all_bounds, lambda b: b < F.col("n_words")))
    placed = rows.withColumn("bucket", bucket).withColumn("cell", F.pmod("mark", F.lit(cells)))
    before = W.partitionBy("bucket").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "cell").agg(F.count("*").alias("n")).select("bucket", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("bucket", "cell").orderBy("mark", "id", "n_words")
    number = F.col("before") + F.col("nth") - 1
    bound = F.get(all_bounds, F.col("bucket"))
    each = F.greatest(F.floor(F.lit(budget) / F.greatest(bound, F.lit(1))), F.lit(1))
    out = placed.withColumn("nth", F.row_number().over(inside)).join(offsets, ["bucket", "cell"])
    return out.select(
        F.col("id").alias(id), *keep, "n_words", "bucket", bound.alias("bound"), F.floor(number / each).alias("batch"), (number % each).alias("slot"),
        (bound - F.col("n_words")).alias("padding"),
    )
