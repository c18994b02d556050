"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A conversation is a sequence of turns; a node is a distinct sequence of its first d turns. Every turn is named by 128 bits of hashes.

1. Conversations are sorted by their sequences in ranges (ties by id, so copies spread over ranges). Neighbours have an edge: the number of turns they share.
2. Inside a range the edges are taken in descending depth. An edge at depth d joins two components: what lies deeper than d is a finished branch, and the
   joined component is a node at depth d with these branches as children. A component keeps its smallest conversation, its sizes and sums, no lists.
3. Components that touch the first or last conversation of a range may go on beyond it; their edges are kept. That is one component per depth at most, so a
   range contracts to a short list. Lists of FAN neighbouring ranges are merged with the edges between them, contracted again, and so on.
4. Each conversation is the smallest member of its nodes below the depth where it joined a smaller one. So the branches' nodes are the rows, and the words
   that sharing saves in a subtree are a sum over joins: the words of the shared prefix at each join, less those above the node.

Sequences are compared in slabs of SLAB turns: a row holds one slab, whatever the conversation's length. Conversations that share a whole slab with another
one and go on are a group of the next slab, whose component takes their place. Ids that end at one node are hashed in order, in joined pieces.

Cases: rows without a conversation id belong to none and are left out; null role or text is empty; null turns come first, equal turns are ordered by role,
then by the md5 of the text; repeated rows are turns like any other; a conversation without turns is a member of the root; an empty table has no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.scratch import settle
from docspark.llm.turns import count_words, placed

SLAB = 256
BLOCK = 1 << 15
FAN = 64
IDS = 4096
ITEM = ("group", "rep", "top", "m", "leaves", "lost", "kids")
_FIELDS = "kind string, part bigint, group bigint, rep bigint, low bigint, high bigint, m bigint, leaves bigint, lost bigint, kids bigint"
_ENDS = ("first_seq", "first_cum", "last_seq", "last_cum")
SCHEMA = f"{_FIELDS}, items array<bigint>, {', '.join(f'{c} array<bigint>' for c in _ENDS)}"
_ARROW = pa.schema([("kind", pa.string()), *((f.split()[0], pa.int64()) for f in _FIELDS.split(", ")[1:]), *((c, pa.list_(pa.int64())) for c in ("items", *_ENDS))])


class Out:
    """Rows of SCHEMA, collected for one Arrow batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, kind, part=None, group=None, rep=None, low=None, high=None, m=None, leaves=None, lost=None, kids=None, items=None, ends=(None,) * 4):
        self.rows.append((kind, part, group, rep, low, high, m, leaves, lost, kids, items, *ends))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class Chain:
    """Components in sorted order with the edges between them: depth (-1: other groups) and words of the shared turns."""

    def __init__(self, items: list[list[int]] | None = None, edges: list[tuple[int, int]] | None = None):
        self.items, self.edges = items or [], edges or []

    def packed(self) -> list[int]:
        return [v for item, edge in zip(self.items, [*self.edges, (0, 0)]) for v in (*item, *edge)]

    @staticmethod
    def unpacked(numbers: list[int]) -> Chain:
        step = len(ITEM) + 2
        rows = [numbers[i : i + step] for i in range(0, len(numbers), step)]
        return Chain([r[:-2] for r in rows], [(r[-2], r[-1]) for r in rows[:-1]])

    def contract(self, out: Out, open_ends: bool) -> Chain:
        """Join along the edges in descending depth; finished branches, joined conversations and finished groups go to ``out``.

        With open ends, components that touch the first or last one stay apart, as what lies beyond may join them at a greater depth.
        """
        group, rep, top, m, leaves, lost, kids = (list(c) for c in zip(*self.items)) if self.items else ([] for _ in ITEM)
        n = len(rep)
        root = list(range(n))
        touched = [False] * n
        if open_ends and n:
            touched[0] = touched[-1] = True

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        by_depth: dict[int, list[int]] = {}
        for at, (depth, _) in enumerate(self.edges):
            if depth >= 0:
                by_depth.setdefault(depth, []).append(at)
        for depth in sorted(by_depth, reverse=True):
            kept, joined = [], []
            for at in by_depth[depth]:
                x, y = find(at), find(at + 1)
                if touched[x] or touched[y]:
                    kept.append(at)
                    continue
                for z in (x, y):
                    if top[z] > depth:
                        leaves[z] = leaves[z] if kids[z] else 1
                        out.add("branch", None, group[z], rep[z], depth + 1, top[z], m[z], leaves[z], lost[z], kids[z])
                        top[z], kids[z] = depth, 1
                if rep[y] < rep[x]:
                    x, y = y, x
                root[y] = x
                m[x], leaves[x], kids[x] = m[x] + m[y], leaves[x] + leaves[y], kids[x] + kids[y]
                lost[x] += lost[y] + self.edges[at][1]
                joined.append((rep[y], x))
            for loser, x in joined:
                out.add("join", rep=loser, low=depth, high=rep[find(x)])
            for at in kept:
                touched[find(at)] = touched[find(at + 1)] = True
        left = Chain()
        edge = (-1, 0)
        for at in range(n):
            x = find(at)
            if at and find(at - 1) == x:
                continue
            edge = self.edges[at - 1] if at else edge
            if touched[x]:
                if left.items:
                    left.edges.append(edge if left_of == at - 1 else (-1, 0))
                left.items.append([group[x], rep[x], top[x], m[x], leaves[x], lost[x], kids[x]])
            else:
                out.add("root", None, group[x], rep[x], None, top[x], m[x], leaves[x], lost[x], kids[x])
                continue
            left_of = at
            while left_of + 1 < n and find(left_of + 1) == x:
                left_of += 1
        return left


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of turns that two sequences (two hashes a turn) share at their start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0] if len(differ) else n) // 2


def _edge(base: int, a: tuple, b: tuple) -> tuple[int, int]:
    """Edge of two (group, sequence, words up to each turn); ``base`` turns were shared before."""
    if a[0] != b[0]:
        return -1, 0
    depth = shared(a[1], b[1])
    return base + depth, int(a[2][depth]) if base + depth else 0


def _local(base: int):
    """Contract a sorted range, BLOCK conversations at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chain, first, last, fresh = Out(), Chain(), None, None, 0
        for batch in batches:
            seqs, cums = batch.column("seq"), batch.column("cum")
            for at, item in enumerate(zip(*(batch.column(c).to_pylist() for c in ITEM))):
                here = item[0], seqs[at].values.to_numpy(zero_copy_only=False), cums[at].values.to_numpy(zero_copy_only=False)
                if last is None:
                    first = here
                else:
                    chain.edges.append(_edge(base, last, here))
                chain.items.append(list(item))
                last, fresh = here, fresh + 1
                if fresh == BLOCK:
                    chain, fresh = chain.contract(out, True), 0
                    yield out.take()
        if last is not None:
            _hand_on(out, chain.contract(out, True), TaskContext.get().partitionId(), first, last)
            yield out.take()

    return run


def _hand_on(out: Out, chain: Chain, part: int, first: tuple, last: tuple) -> None:
    out.add("open", part, first[0], last[0], items=chain.packed(), ends=(first[1], first[2], last[1], last[2]))


def _merge(base: int, final: bool):
    """Merge the lists of neighbouring ranges, which come sorted by target and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chain, target, first, last = Out(), Chain(), None, None, None

        def finished():
            left = chain.contract(out, not final)
            if not final:
                _hand_on(out, left, target, first, last)
            return out.take()

        for batch in batches:
            for row in batch.to_pylist():
                a, b = ((row[g], np.array(row[s], np.int64), np.array(row[c], np.int64)) for g, s, c in (("group", *_ENDS[:2]), ("rep", *_ENDS[2:])))
                part = Chain.unpacked(row["items"])
                if target is not None and row["target"] != target:
                    yield finished()
                    target = None
                if target is None:
                    chain, first, target = part, a, row["target"]
                else:
                    chain = Chain(chain.items + part.items, [*chain.edges, _edge(base, last, a), *part.edges]).contract(out, True)
                last = b
        if target is not None:
            yield finished()

    return run


def _forest(items: DataFrame, base: int) -> DataFrame:
    """Rows of SCHEMA (branch, join, root) of all groups of items; ``base`` turns are shared inside every group."""
    order = ["group", "seq", "rep"]
    rows = items.repartitionByRange(*order).sortWithinPartitions(*order).select(*ITEM, "seq", "cum")
    made = settle(rows.mapInArrow(_local(base), SCHEMA))
    all_rows = made.filter("kind <> 'open'")
    width = (made.agg(F.max("part").alias("part")).first()["part"] or 0) + 1
    while True:
        lists = made.filter("kind = 'open'").withColumn("target", F.floor(F.col("part") / FAN)).repartition("target").sortWithinPartitions("target", "part")
        made = settle(lists.mapInArrow(_merge(base, width <= FAN), SCHEMA))
        all_rows = all_rows.union(made.filter("kind <> 'open'"))
        if width <= FAN:
            return all_rows
        width = -(-width // FAN)


def _slab(turns: DataFrame, base: int, slab: int) -> DataFrame:
    """conv, seq, cum: the turns base + 1 .. base + slab of every conversation, and the words up to each, from ``base`` on."""
    rows = turns.filter((F.col("d") > base) & (F.col("d") <= base + slab)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("d", "h1", "h2", "words", "cum"))).alias("t"))
    before = F.col("t")[0]["cum"] - F.col("t")[0]["words"]
    return rows.select("conv", F.flatten(F.transform("t", lambda x: F.array(x["h1"], x["h2"]))).alias("seq"), F.concat(F.array(before), F.transform("t", lambda x: x["cum"])).alias("cum"))


def _named(seq: Column) -> list[Column]:
    return [F.xxhash64(seq).alias("s1"), F.xxhash64(F.lit(1), seq).alias("s2")]


def _levels(turns: DataFrame, convs: DataFrame, slab: int) -> list[DataFrame]:
    """Per slab: group, conv, length, seq, cum of the conversations that share all turns before with another one."""
    members, levels = convs.select(F.lit(0).cast("bigint").alias("group"), "conv", "length"), []
    while True:
        base = len(levels) * slab
        none = F.array().cast("array<bigint>")
        held = members.join(_slab(turns, base, slab), "conv", "left")
        levels.append(settle(held.select("group", "conv", "length", F.coalesce("seq", none).alias("seq"), F.coalesce("cum", F.array(F.lit(0).cast("bigint"))).alias("cum"))))
        full = levels[-1].filter(F.col("length") > base + slab).select("group", "conv", "length", *_named(F.col("seq")))
        names = settle(full.groupBy("group", "s1", "s2").agg(F.min("conv").alias("next"), F.count("*").alias("n")).filter("n > 1").drop("n"))
        if names.isEmpty():
            return levels
        members = full.join(names, ["group", "s1", "s2"]).select(F.col("next").alias("group"), "conv", "length")


def forest(turns: DataFrame, convs: DataFrame, slab: int = SLAB) -> DataFrame:
    """Rows of SCHEMA for the whole trie: branches, joins, and the root of group 0."""
    levels = _levels(turns, convs, slab)
    found, deeper = None, None
    for at in reversed(range(len(levels))):
        own = levels[at].select("group", F.col("conv").alias("rep"), F.col("length").alias("top"), F.lit(1).cast("bigint").alias("m"), *(F.lit(0).cast("bigint").alias(c) for c in ITEM[4:]), "seq", "cum")
        if deeper is not None:
            inside = levels[at + 1].select(F.col("conv").alias("rep"))
            heads = levels[at].select("group", F.col("conv").alias("inner"), "seq", "cum")
            roots = deeper.filter("kind = 'root'").select(F.col("group").alias("inner"), "rep", F.col("high").alias("top"), *ITEM[3:]).join(heads, "inner")
            own = own.join(inside, "rep", "left_anti").select(*ITEM, "seq", "cum").union(roots.select(*ITEM, "seq", "cum"))
        deeper = _forest(own, at * slab)
        rest = deeper if at == 0 else deeper.filter("kind <> 'root'")
        found = rest if found is None else found.union(rest)
    return found


def _joins(found: DataFrame) -> DataFrame:
    """loser, depth, winner: the depth at which each conversation joined smaller ones, and the smallest member there.

    A winner may have joined a smaller one at the same depth in a later merge; the few such pairs are followed, as many times as lists were merged.
    """
    joins = settle(found.filter("kind = 'join'").select(F.col("rep").alias("loser"), F.col("low").alias("depth"), F.col("high").alias("winner")))
    onward = joins.select(F.col("loser").alias("winner"), "depth", F.col("winner").alias("next"))
    moved = settle(joins.select("winner", "depth").distinct().join(onward, ["winner", "depth"]))
    while True:
        again = moved.join(moved.select(F.col("winner").alias("next"), "depth", F.col("next").alias("after")), ["next", "depth"], "left")
        after = settle(again.select("winner", "depth", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("changed")))
        if after.filter("changed").isEmpty():
            break
        moved = after.drop("changed")
    return settle(joins.join(moved, ["winner", "depth"], "left").select("loser", "depth", F.coalesce("next", "winner").alias("winner")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node, joined by commas, up to IDS in a piece."""
    rep, depth, ids = None, None, []

    def piece():
        return pa.RecordBatch.from_pydict({"rep": [rep], "depth": [depth], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for r, d, conv in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "conv"))):
            if ids and ((r, d) != (rep, depth) or len(ids) == IDS):
                done.append(piece())
                ids = []
            rep, depth = r, d
            ids.append(conv)
        yield from _one_batch(done)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the sorted pieces of a node, one piece at a time."""
    key, state = None, None

    def digest():
        return pa.RecordBatch.from_pydict({"rep": [key[0]], "depth": [key[1]], "sha256": [state.hexdigest()]})

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for r, d, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids"))):
            if (r, d) == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append(digest())
                key, state = (r, d), hashlib.sha256()
            state.update(ids.encode())
        yield from _one_batch(done)
    if key is not None:
        yield digest()


def _one_batch(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from pa.Table.from_batches(rows).combine_chunks().to_batches()


def _ends(convs: DataFrame, joins: DataFrame) -> DataFrame:
    """rep, depth, sha256 of the ids of the conversations that end at each node."""
    own = F.col("depth").isNull() | (F.col("length") > F.col("depth"))
    ended = convs.join(joins, F.col("conv") == F.col("loser"), "left").select(F.when(own, F.col("conv")).otherwise(F.col("winner")).alias("rep"), F.col("length").alias("depth"), "conv")
    order = ["rep", "depth", "conv"]
    joined = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "rep bigint, depth bigint, first bigint, ids string")
    return joined.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(_digests, "rep bigint, depth bigint, sha256 string")


def nodes(turns: DataFrame, convs: DataFrame, slab: int = SLAB) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns``: conv, d (from 1), h1, h2, words, cum; ``convs``: conv, length, one row per conversation.
    """
    turns, convs = settle(turns), settle(convs)
    found = forest(turns, convs, slab)
    joins = _joins(found)
    root = found.filter("kind = 'root'").withColumn("leaves", F.when(F.col("kids") > 0, F.col("leaves")).otherwise(F.lit(1)))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    columns = ("rep", "low", "high", "m", "leaves", "lost", "kids")
    top = root.select("rep", zero.alias("low"), zero.alias("high"), "m", "leaves", "lost", F.when(F.col("high") > 0, one).otherwise(F.col("kids")).alias("kids"))
    trunk = root.filter("high > 0").withColumn("low", one).select(*columns)
    branches = found.filter("kind = 'branch'").select(*columns).union(trunk).union(top)
    above = joins.select(F.col("loser").alias("rep"), (F.col("depth") + 1).alias("low"), "winner")
    branches = branches.join(above, ["rep", "low"], "left")
    each = branches.withColumn("depth", F.explode(F.sequence("low", "high"))).select(
        F.col("rep"), "depth", F.when(F.col("depth") > F.col("low"), F.col("rep")).when(F.col("depth") > 0, F.coalesce("winner", "rep")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"), F.when(F.col("depth") == F.col("high"), F.col("kids")).otherwise(one).alias("n_children"), F.col("leaves").alias("n_leaves"), "lost",
    )
    each = settle(each)
    below = turns.select(F.col("conv").alias("rep"), (F.col("d") + 1).alias("depth"), "cum")
    deep = (F.col("n_convs") > 1) & (F.col("depth") > 1)
    shared_nodes = each.filter(deep).join(below, ["rep", "depth"]).withColumn("saved_tokens", F.col("lost") - (F.col("n_convs") - 1) * F.col("cum"))
    plain = each.filter(~deep).withColumn("saved_tokens", F.col("lost"))
    rows = shared_nodes.select(*plain.columns).union(plain).join(_ends(convs, joins), ["rep", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(nothing)).alias("ends_sha256"))


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, d, h1, h2, words, cum of every turn: its place, name and words. No text is shuffled."""
    body, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    slim = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"), F.md5(body.cast("binary")).alias("mark"), count_words(body).alias("words"))
    rows = placed(slim.filter("conv is not null"), "conv", ["turn", "role", "mark"], "words")
    return rows.select("conv", F.col("place").alias("d"), F.xxhash64("role", "mark").alias("h1"), F.xxhash64(F.lit(1), "mark", "role").alias("h2"), "words", "cum")


def with_common_heads(turns: DataFrame, decade: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """turns and convs after every conversation c takes the first h turns of conversation c - c % ``decade`` in place of its own first h.

    h is crc32(c) % ``most``. A conversation meets one other, and a head is ``most`` - 1 turns long at most, so no key gathers many rows.
    """
    first = most - 1
    heads = [F.coalesce(F.sum(F.when(F.col("d") <= k, F.col("words"))), F.lit(0)).alias(f"w{k}") for k in range(most)]
    own = settle(turns.groupBy("conv").agg(F.count("*").alias("n"), *heads))
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % most).alias("h")
    words_to = lambda table, k: F.element_at(F.array(*(F.col(f"{table}.w{i}") for i in range(most))), (k + 1).cast("int"))
    asked = own.select("*", h, (F.col("conv") - F.col("conv") % decade).alias("base")).alias("a")
    met = asked.join(own.alias("b"), F.col("a.base") == F.col("b.conv"), "left")
    taken = F.least(F.col("a.h"), F.coalesce(F.col("b.n"), F.lit(0)))
    plan = met.select(
        F.col("a.conv").alias("conv"), "a.base", "a.h", taken.alias("taken"), (taken + F.greatest(F.col("a.n") - F.col("a.h"), F.lit(0))).alias("length"),
        (F.coalesce(words_to("b", taken), F.lit(0)) - words_to("a", F.col("a.h"))).alias("shift"),
    )
    plan = settle(plan)
    kept = turns.join(plan, "conv").filter("d > h").select("conv", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "h1", "h2", "words", (F.col("cum") + F.col("shift")).alias("cum"))
    lent = turns.filter(F.col("d") <= first).withColumnRenamed("conv", "base").join(plan.filter("taken > 0"), "base").filter("d <= taken").select("conv", "d", "h1", "h2", "words", "cum")
    return kept.union(lent), plan.select("conv", "length")
