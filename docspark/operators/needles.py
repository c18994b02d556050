"""Many needles in one pass: an Aho-Corasick automaton of the distinct needles, run over whole strings in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_CHARS = 1 << 20
_made: dict[str, ahocorasick.Automaton] = {}


def automaton(needles: list[str]) -> ahocorasick.Automaton:
    """An automaton that reports the number of every needle it meets, also inside another one."""
    made = ahocorasick.Automaton()
    for no, needle in enumerate(needles):
        made.add_word(needle, no)
    made.make_automaton()
    return made


def _of_worker(named: tuple[str, list[str]]) -> tuple[ahocorasick.Automaton, list[str]]:
    """The automaton of a group, made once per worker; a worker keeps one."""
    name, needles = named
    if name not in _made:
        _made.clear()
        _made[name] = automaton(needles)
    return _made[name], needles


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, names = _of_worker(shared.value)
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column("hay").to_pylist()):
                met = {no for _, no in made.iter(text)} if text and names else None
                if met:
                    rows.append(row)
                    hits.append([names[no] for no in met])
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), pa.array(hits, pa.list_(pa.string()))], names=["row", "needles"])

    return run


def found(rows: DataFrame, hay: str, needles: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and needle, for every row and every distinct needle (not empty) that its string ``hay`` contains.

    Needles are measured first and broadcast in groups of about GROUP_CHARS characters, so a worker's automaton has a size bound; strings are read
    once per group and never shuffled. A null string contains nothing.
    """
    asked = needles.select("needle").filter(F.length("needle") > 0).distinct()
    chars = asked.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("chars")).first()["chars"]
    groups = max(1, -(-chars // GROUP_CHARS))
    packed = rows.select(F.struct(*(F.col(c) for c in keep)).alias("row"), F.col(hay).alias("hay"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, needles array<string>"
    out = None
    for group in range(groups):
        part = asked.filter(F.pmod(F.xxhash64("needle"), F.lit(groups)) == group)
        shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["needle"] for r in part.collect()]))
        hits = packed.mapInArrow(_scan(shared), schema).select("row.*", F.explode("needles").alias("needle"))
        out = hits if out is None else out.unionByName(hits)
    return out
