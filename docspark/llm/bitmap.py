"""A bitmap of 64-bit hashes with a fixed bound on its size, built in Spark and tested in tasks.

A test never misses a hash that is in the set; how many others pass depends on the size. So a pass of the bitmap only saves work, and
exact joins decide.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 29
BITS_PER_HASH = 32
PROBES = 3
SHIFT = 17


def build(hashes: DataFrame, column: str) -> Broadcast:
    """Broadcast bits for the column's values: 32 bits a value, PROBES of them set, 64 MB at most."""
    spark = hashes.sparkSession
    n = hashes.count()
    bits = min(MOST_BITS, 1 << max(16, (n * BITS_PER_HASH - 1).bit_length()))
    spots = F.array(*(F.shiftrightunsigned(column, SHIFT * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)))
    spot = F.col("spot")
    cells = hashes.select(F.explode(spots).alias("spot")).select(F.shiftright(spot, 15).alias("cell"), spot.bitwiseAND(F.lit(32767)).alias("bit"))
    rows = cells.groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect()
    held = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        held[row["cell"] * 4096 : row["cell"] * 4096 + 4096] = np.frombuffer(row["bitmap"], np.uint8)[: bits // 8]
    return spark.sparkContext.broadcast(held)


def holds(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned values may be in the set."""
    found = np.ones(len(values), bool)
    for i in range(PROBES):
        spot = (values >> np.uint64(SHIFT * i)) & np.uint64(len(held) * 8 - 1)
        found &= (held[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
