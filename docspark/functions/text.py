"""Column expressions over text: trimming, page offsets, splitting and packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import profiles as P


FEW_PARTS = 32


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(P.WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def nonblank(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~is_blank(p))


def running_starts(lengths: Column, gap: int = 0) -> Column:
    """Start offset of every part, given the part lengths (one more entry than parts: the end).

    Few parts are added up one by one. Many are added in doubling steps: after step k every entry holds the sum of the last 2^k, so n parts take n log n.
    """
    zero = F.array(F.lit(0))
    one_by_one = F.aggregate(lengths, zero, lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n + F.lit(gap)))

    def double(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: x + F.when(i >= back, F.get(acc, i - back)).otherwise(F.lit(0)))

    shifted = F.concat(zero, F.transform(lengths, lambda n: n + F.lit(gap)))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + 1)).cast("int"))
    return F.when(F.size(lengths) <= FEW_PARTS, one_by_one).otherwise(F.aggregate(steps, shifted, double))


def offset_to_page(offset: Column, boundaries: Column) -> Column:
    """As-of lookup: the last page that starts at or before ``offset`` (1 when there is none). Pages come in order; many are searched by halving."""
    hit = F.filter(boundaries, lambda b: b["start"] <= offset)
    listed = F.when(F.size(hit) > 0, F.element_at(hit, -1)["page_num"]).otherwise(F.lit(1))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        after = F.get(boundaries, middle)["start"] <= offset
        moved = F.struct(F.when(after, middle + 1).otherwise(acc["low"]).alias("low"), F.when(after, acc["high"]).otherwise(middle).alias("high"))
        return F.when(acc["low"] < acc["high"], moved).otherwise(acc)

    whole = F.struct(F.lit(0).alias("low"), F.size(boundaries).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(boundaries) + 1)).cast("int"))
    before = F.aggregate(steps, whole, halve, lambda acc: acc["low"])
    found = F.coalesce(F.get(boundaries, before - 1)["page_num"], F.lit(1))
    return F.when(F.size(boundaries) <= FEW_PARTS, listed).otherwise(F.when(before > 0, found).otherwise(F.lit(1)))


def pack(parts: Column, limit: int = P.MAX_CHUNK_LEN) -> Column:
    """Join neighbouring parts with a newline while the result stays within ``limit`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.concat(acc["open"], F.lit("\n"), part)
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), part.alias("open")))
            .when(
                F.length(acc["open"]) + F.length(part) + 1 <= limit,
                F.struct(acc["done"].alias("done"), joined.alias("open")),
            )
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), part.alias("open")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    return F.aggregate(nonblank(parts), start, step, finish)


def slices(line: Column, limit: int = P.MAX_CHUNK_LEN) -> Column:
    """The line cut every ``limit`` characters; a short line comes back as it is."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(line) - 1, F.lit(0)), F.lit(limit))
    return F.when(F.length(line) <= limit, F.array(line)).otherwise(
        F.transform(starts, lambda i: F.substring(line, i + 1, F.lit(limit)))
    )


def split_lines(text: Column, limit: int = P.MAX_CHUNK_LEN) -> Column:
    """Lines, over-long ones sliced, packed up to ``limit``."""
    return pack(F.flatten(F.transform(F.split(text, "\n"), lambda line: slices(line, limit))), limit)


def item_boundary(markers: tuple[str, ...]) -> str:
    return r"(?=\n\s*(?:" + "|".join(markers) + "))"


def split_items(text: Column, markers: tuple[str, ...] = P.ITEM_MARKERS) -> Column:
    """Text cut before item markers, blank pieces dropped."""
    return nonblank(F.split(text, item_boundary(markers)))


def split_long(text: Column, markers: tuple[str, ...] = P.ITEM_MARKERS, limit: int = P.MAX_CHUNK_LEN) -> Column:
    """Items first, then lines, then hard slices; neighbours packed back together up to ``limit``."""
    pieces = F.flatten(
        F.transform(
            split_items(text, markers),
            lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(split_lines(p, limit)),
        )
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pack(pieces, limit))


def parent_label(label: Column) -> Column:
    """Label without its part suffix."""
    return F.split_part(label, F.lit(" (part "), F.lit(1))


def part_number(label: Column) -> Column:
    """Part number in the label, 0 for a label without parts."""
    return F.coalesce(F.regexp_extract(label, r"\(part (\d+)/\d+\)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
