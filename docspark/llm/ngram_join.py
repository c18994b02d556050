"""N-gram Jaccard join by token-combination prefixes.

A text's tokens are the hashes of its distinct word shingles. Texts link when den * |x & y| >= num * |x | y|.

1. *Counts.* Every text adds its tokens to 2^18 counters, summed in Spark. A token is frequent when its counter stands out. All texts order
   their tokens by (counter, hash), rare ones first; any common order is right, the counters only make it a good one.
2. *Prefixes.* A linked partner misses at most t = n - ceil(n * num / den) of a text's n tokens. Rare tokens of the prefix are indexed one by
   one. Frequent ones are dealt into parts and indexed as k-token combinations inside a part: c tokens in a part can miss
   c - k + 1 before no combination is shared. A prefix is extended until rare tokens and parts together can miss t + 1, so linked texts
   share a signature. The number of parts belongs to a range of sizes; a text emits combinations for its own range and the next, so that
   partners always meet in one.
3. *Candidates.* Texts with equal sets are one node. Signatures are shuffled once, sorted; a pass over them keeps the groups of several nodes. In every
   group the nodes are paired with the smallest of them, which is as many pairs as members; those whose sizes and 64 counters of tokens allow a link
   (an upper bound of the similarity, so nothing is lost) are compared token by token, and the linked ones are joined to components.
4. *Verification of the rest.* Only groups that still hold several components are compared further, in blocks inside tasks: first by sizes and
   64 counters, then by a sketch of a counter for every two to four tokens (the same bound, but as sharp for long texts as for short ones). That leaves
   the nodes that can have a link to another component, and only these meet with their tokens. Pairs whose components a link has joined
   are skipped, so a task hands on fewer links than it has nodes. Components follow from all links.

Cases: a null or blank text has no tokens and links with nothing; with fewer than k words the whole sequence is the only token; repeated rows are
one node, each returned; ids may repeat, the component is the smallest id of its rows (null ids are ignored in it, and a component of them alone is
null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import bitmap
from docspark.llm.components import components
from docspark.llm.scratch import discard, settle, settle_wide
from docspark.llm.words import mix, multipliers, pieces, words

COUNTERS = 1 << 18
BLOCK = 1024
TOKEN_BLOCK = 256
_MIX = multipliers(8, 11)


def token_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct tokens of each text."""
    found = words(column, lower=True)
    rolled = found.shingles(k, multipliers(k, 7))
    salt = multipliers(k, 13)
    out = []
    for a, b in zip(found.at[:-1].tolist(), found.at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix((found.hashes[a:b] * salt[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_marks(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one, two = (int(mix(tokens + c).sum(dtype=np.uint64)) for c in _MIX[:2])
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


class Recent:
    """The last sets that a task met, one in each of 2^16 slots. It knows most copies again and takes no set for another."""

    def __init__(self):
        self.slots: dict[int, tuple[int, int]] = {}

    def new(self, name: tuple[int, int]) -> bool:
        slot = name[0] & 0xFFFF
        if self.slots.get(slot) == name:
            return False
        self.slots[slot] = name
        return True


def needed(n: int, num: int, den: int) -> int:
    """Tokens that a partner must share with a set of n."""
    return -(-n * num // den)


def size_bounds(most: int, num: int, den: int) -> list[int]:
    """First size of each range; linked sets are in the same range or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return out


class Prefixes:
    """Signatures of token sets. ``sizes`` holds the combination size of each class, rarest first; ``bounds`` the classes' counter limits."""

    def __init__(self, counters: np.ndarray, sizes: tuple[int, ...], bounds: tuple[int, ...], num: int, den: int):
        self.counters, self.sizes, self.num, self.den = counters, sizes, num, den
        self.bounds = np.array(bounds, np.int64)
        self.slack = sum(s - 1 for s in sizes)
        self.ranges = size_bounds(1 << 20, num, den)

    def _range(self, n: int) -> int:
        while self.ranges[-1] <= n:
            self.ranges += [self.ranges[-1] * self.den // self.num + 1]
        return int(np.searchsorted(self.ranges, n, side="right")) - 1

    def _parts(self, cell: int, size: int) -> int:
        """Into how many parts tokens of a class are dealt for sets of a range and the one before."""
        self._range(self.ranges[min(cell, len(self.ranges) - 1)])
        low, under = self.ranges[cell], self.ranges[max(0, cell - 1)]
        can_miss = low - needed(low, self.num, self.den)
        return max(1, min((can_miss + 1) // (2 * (size - 1)), (needed(under, self.num, self.den) - 1) // max(1, self.slack)))

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        must = needed(n, self.num, self.den)
        counts = self.counters[(tokens % np.uint64(len(self.counters))).astype(np.int64)]
        order = np.lexsort((tokens, counts))
        miss = n - must
        head = order[: miss + 1]
        out: list[np.ndarray] = []
        if needed(must, self.num, self.den) <= self.slack:  # too few tokens for combinations: all of them, and all partners' too
            out.append(mix(tokens ^ _MIX[2]))
        if counts[head[-1]] <= self.bounds[0]:
            out.append(mix(tokens[head] ^ _MIX[3]))
            return np.unique(np.concatenate(out))
        classes = np.searchsorted(self.bounds, counts[order], side="left")
        sorted_tokens = tokens[order]
        own = self._range(n)
        for cell in (own, own + 1):
            out += self._extended(sorted_tokens, classes, miss, cell)
        return np.unique(np.concatenate(out))

    def _extended(self, tokens: np.ndarray, classes: np.ndarray, miss: int, cell: int) -> list[np.ndarray]:
        """Signatures of the prefix that can miss ``miss`` tokens, for one range of sizes."""
        self._range(self.ranges[-1] if cell >= len(self.ranges) - 1 else 1)
        rare = int(np.searchsorted(classes, 0, side="right"))
        held: dict[tuple[int, int], list[int]] = {}
        safe = min(rare, miss + 1)
        at = safe
        parts = [0] + [self._parts(cell, s) for s in self.sizes[1:]]
        values = tokens.tolist()
        while safe <= miss and at < len(values):
            c = int(classes[at])
            group = held.setdefault((c, (values[at] >> 20) % parts[c]), [])
            group.append(values[at])
            safe += len(group) >= self.sizes[c]
            at += 1
        out = [mix(tokens[: min(rare, miss + 1)] ^ _MIX[3])]
        for (c, _), group in held.items():
            if len(group) >= self.sizes[c]:
                chosen = np.array(list(combinations(sorted(group), self.sizes[c])), np.uint64)
                salt = np.uint64((cell * 8 + c) * 0x9E3779B97F4A7C15 % 2**64)
                out.append(mix((chosen * _MIX[4 : 4 + self.sizes[c]]).sum(axis=1, dtype=np.uint64) ^ salt))
        return out


def _profile(k: int, marked: bool):
    """Rows of two kinds: a document's size and set name (and its mark, if rows have one), and the task's counters."""
    more = ["mark"] if marked else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in pieces(batches, "text"):
            sets = token_sets(batch.column("text"), k)
            marks = [set_marks(s) for s in sets]
            counters += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(sets), pa.int32()), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()), pa.array([histogram(s) if len(s) else None for s in sets], pa.binary()),
                    *(batch.column(c) for c in more),
                ],
                names=["counter", "id", "n", "s1", "s2", "hist", *more],
            )
        at = np.flatnonzero(counters)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), none, pa.array(counters[at]), none, none, pa.nulls(len(at), pa.binary()), *(none for _ in more)], names=["counter", "id", "n", "s1", "s2", "hist", *more])

    return run


def _signatures(k: int, sizes, bounds, num: int, den: int, counters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, recent = Prefixes(counters.value, sizes, bounds, num, den), Recent()
        for batch in pieces(batches, "text"):
            named = [(s, set_marks(s)) for s in token_sets(batch.column("text"), k) if len(s)]
            named = [(s, name) for s, name in named if recent.new(name)]
            found = [prefixes.signatures(s) for s, _ in named]
            if found:
                nodes = np.repeat(np.array([name[0] for _, name in named], np.int64), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(nodes)], names=["sig", "node"])

    return run


def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, hub, node of the signatures that several nodes have, each node once; hub is the smallest. The rows come sorted by sig and node.

    Of a group that a batch does not end, only its hub, its last node and whether that is the hub are held.
    """
    held = None
    for batch in batches:
        sig, node = (batch.column(c).to_numpy() for c in ("sig", "node"))
        if not len(sig):
            continue
        new_sig = np.append(True, sig[1:] != sig[:-1])
        new_node = np.append(True, node[1:] != node[:-1]) | new_sig
        if held is not None and held[0] == sig[0]:
            new_sig[0], new_node[0] = False, held[2] != node[0]
        sig, node, starts = sig[new_node], node[new_node], new_sig[new_node]
        if not len(sig):
            continue
        group = np.cumsum(starts)
        hubs = np.append(0 if held is None else held[1], node[starts])[group]
        after_hub = np.append(held is not None and held[2] == held[1], starts[:-1]) & ~starts
        to = np.flatnonzero(~starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([sig[after_hub], sig[to]])), pa.array(np.concatenate([hubs[after_hub], hubs[to]])), pa.array(np.concatenate([hubs[after_hub], node[to]]))],
            names=["sig", "hub", "node"],
        )
        held = (sig[-1], hubs[-1], node[-1])


def histogram(tokens: np.ndarray) -> bytes:
    """64 counters of a set, up to 255. Their distance is at most the number of tokens that only one of two sets has."""
    return np.minimum(np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def sketch(tokens: np.ndarray) -> bytes:
    """``histogram`` with a counter for every two to four tokens, 64 at least."""
    bits = max(6, (len(tokens) - 1).bit_length() - 2)
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(counters: np.ndarray, width: int) -> np.ndarray:
    return counters if len(counters) == width else counters.reshape(width, -1).sum(axis=1, dtype=np.int64)


def sketch_gap(x: np.ndarray, y: np.ndarray) -> int:
    """At most the number of tokens that only one of two sets has, from their sketches as int16."""
    width = min(len(x), len(y))
    return int(np.abs(folded(x, width) - folded(y, width)).sum(dtype=np.int64))


def row_keys(nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What ``_row_key`` gives in Spark."""
    ids = ids.view(np.uint64)
    return nodes.view(np.uint64) ^ ids ^ (ids << np.uint64(bitmap.SHIFT)) ^ (ids << np.uint64(2 * bitmap.SHIFT))


def _row_key(node: str, id: str):
    """A value of the set and the id of a row, with the id in the bits of every probe of a bitmap."""
    known = F.coalesce(F.col(id), F.lit(0).cast("bigint"))
    return F.col(node).bitwiseXOR(known).bitwiseXOR(F.shiftleft(known, bitmap.SHIFT)).bitwiseXOR(F.shiftleft(known, 2 * bitmap.SHIFT))


def _sets(k: int, live):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in pieces(batches, "text"):
            sets = token_sets(batch.column("text"), k)
            names = [set_marks(s) for s in sets]
            nodes = np.array([name[0] for name in names], np.int64)
            ids = pc.fill_null(batch.column("id"), 0).to_numpy()
            wanted = np.flatnonzero(bitmap.holds(live.value, row_keys(nodes, ids))).tolist()
            rows = [i for i in wanted if len(sets[i]) and recent.new(names[i])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[rows]), pa.array([names[i][1] for i in rows], pa.int64()), pa.array([len(sets[i]) for i in rows], pa.int64()),
                    pa.array([sketch(sets[i]) for i in rows], pa.binary()), pa.array([sets[i].tobytes() for i in rows], pa.binary()),
                ],
                names=["node", "s2", "n", "sketch", "tokens"],
            )

    return run


def may_link(n1, n2, gap, num: int, den: int):
    """Whether sets of these sizes, of whose tokens at least ``gap`` lie in one only, can link."""
    return (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & (gap * (den + num) <= (n1 + n2) * (den - num))


def _hist_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 64).astype(np.int16)


def _possible(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = np.abs(_hist_rows(batch.column("hist_a")) - _hist_rows(batch.column("hist_b"))).sum(axis=1)
            n1, n2 = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            yield batch.filter(pa.array(may_link(n1, n2, gap, num, den))).select(["a", "b"])

    return run


def possible_pairs(cell: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, hist: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with one cell number (neighbours) that have different labels and may link.

    All rows are compared with the row d places on, for growing d, so small cells cost no loop of their own. In a cell of two blocks only rows of
    different blocks meet.
    """
    first = np.arange(len(cell))
    for d in range(1, len(cell)):
        first = first[first + d < len(cell)]
        first = first[cell[first] == cell[first + d]]
        if not len(first):
            break
        a, b = first, first + d
        met = (label[a] != label[b]) & ((side[a] == 0) | (side[a] != side[b])) & may_link(n[a], n[b], 0, num, den)
        a, b = a[met], b[met]
        near = may_link(n[a], n[b], np.abs(hist[a] - hist[b]).sum(axis=1, dtype=np.int64), num, den)
        yield a[near], b[near]


def by_cell(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole cells of rows that come sorted by the keys, with each row's cell number; the cell at a batch's end waits for the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        values = np.stack([table.column(c).to_numpy().astype(np.int64) for c in keys])
        new = np.append(True, (values[:, 1:] != values[:, :-1]).any(axis=0))[: table.num_rows]
        starts = np.flatnonzero(new)
        whole = int(starts[-1]) if len(starts) else 0
        rest = table.slice(whole)
        yield table.slice(0, whole), np.cumsum(new[:whole])
    if rest is not None:
        yield rest, np.zeros(rest.num_rows, np.int64)


def _open_rows(num: int, den: int):
    """hub and node of the rows that have a possible partner of another component in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in by_cell(batches, ("sig", "i", "j")):
            label, n, side = (table.column(c).to_numpy() for c in ("label", "n", "side"))
            hit = np.zeros(table.num_rows, bool)
            for a, b in possible_pairs(cell, label, n, side, _hist_rows(table.column("hist")), num, den):
                hit[a] = hit[b] = True
            yield from table.filter(pa.array(hit)).select(["hub", "node"]).to_batches()

    return run


def _near_rows(num: int, den: int):
    """hub, node and label of the rows that have a possible partner of another component in their cell, by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in by_cell(batches, ("hub", "i", "j")):
            label, n, side = (table.column(c).to_numpy() for c in ("label", "n", "side"))
            sketches = [np.frombuffer(x, np.uint8).astype(np.int16) for x in table.column("sketch").to_pylist()]
            hist = np.array([folded(x, 64) for x in sketches], np.int32).reshape(-1, 64)
            hit = np.zeros(table.num_rows, bool)
            for a, b in possible_pairs(cell, label, n, side, hist, num, den):
                for x, y in zip(a.tolist(), b.tolist()):
                    if not (hit[x] and hit[y]) and may_link(n[x], n[y], sketch_gap(sketches[x], sketches[y]), num, den):
                        hit[x] = hit[y] = True
            yield from table.filter(pa.array(hit)).select(["hub", "node", "label"]).to_batches()

    return run


def _links(num: int, den: int):
    """Links between components inside each cell, token by token; pairs whose components a link has joined are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in by_cell(batches, ("hub", "i", "j")):
            node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
            tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
            n = np.array([len(t) for t in tokens], np.int64)
            sketches = [np.frombuffer(sketch(t), np.uint8).astype(np.int16) for t in tokens]
            hist = np.array([folded(x, 64) for x in sketches], np.int32).reshape(-1, 64)
            parent: dict[tuple[int, int], tuple[int, int]] = {}

            def top(x):
                while x in parent:
                    x = parent[x]
                return x

            found = []
            for a, b in possible_pairs(cell, label, n, side, hist, num, den):
                for x, y in zip(a.tolist(), b.tolist()):
                    one, two = top((int(cell[x]), int(label[x]))), top((int(cell[y]), int(label[y])))
                    if one != two and may_link(n[x], n[y], sketch_gap(sketches[x], sketches[y]), num, den) and linked(tokens[x], tokens[y], num, den):
                        parent[one] = two
                        found.append((int(node[x]), int(node[y])))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * den >= num * (len(x) + len(y) - both)


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist())
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in pairs]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return run


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select(*(F.col(c).alias({"node": x}.get(c, f"{c}_{x}")) for c in df.columns))


def _filtered(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and histograms let link."""
    small = nodes.select("node", "n", "hist")
    return pairs.join(_side(small, "a"), "a").join(_side(small, "b"), "b").mapInArrow(_possible(num, den), "a bigint, b bigint").distinct()


def _token_sets(asked: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, s2, n, sketch, tokens of the asked nodes, written where the texts are read.

    A text is taken if a bitmap may hold its set and its id as the first of the set. So other nodes and repeats may be among the rows, but few.
    """
    firsts = asked.join(nodes, "node").select(_row_key("node", "first").alias("key"))
    return settle_wide(rows.mapInArrow(_sets(k, bitmap.build(settle(firsts), "key")), "node bigint, s2 bigint, n bigint, sketch binary, tokens binary"))


def _by_node(sets: DataFrame, *columns: str) -> DataFrame:
    """node and these columns, each set once."""
    return sets.select("node", "s2", *columns).repartition("node").dropDuplicates(["node", "s2"]).drop("s2")


def _linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""
    asked = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = _token_sets(asked, rows, nodes, k)
    of_node = _by_node(sets, "tokens")
    out = settle_wide(pairs.join(_side(of_node, "a"), "a").join(_side(of_node, "b"), "b").mapInArrow(_verify(num, den), "a bigint, b bigint").distinct())
    discard(sets)
    return out


def _cells(rows: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """The rows of the keys in ``sizes`` (key, size), once for each cell (key, i, j) of two blocks of about ``block`` rows. side: 0 if both blocks are one, else -1 or 1."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), F.signum(x - F.col("own")).cast("int").alias("side")))
    dealt = rows.join(sizes.select(key, blocks.alias("blocks")), key).withColumn("own", own)
    return dealt.withColumn("cell", F.explode(cells)).select(*rows.columns, "cell.*")


def _met(cells: DataFrame, key: str) -> DataFrame:
    return cells.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _open_links(members: DataFrame, labels: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components that share a signature group, as few as join what they join.

    Sizes and histograms, in the signature groups, tell which nodes can have such a link. Those nodes meet once more in the groups of their hub, first
    with their sketches, and the ones that still can have a link with their tokens.
    """
    known = members.join(labels, members["node"] == labels["labelled"], "left").select("sig", "hub", "node", F.coalesce("component", "node").alias("label"))
    several = known.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi and size > 2")
    groups = _met(_cells(known, several, "sig", BLOCK).join(nodes.select("node", "n", "hist"), "node"), "sig")
    open_ = settle(groups.mapInArrow(_open_rows(num, den), "hub bigint, node bigint").distinct())
    if not open_.limit(1).count():
        return open_.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    sets = _token_sets(settle(open_.select("node").distinct()), rows, nodes, k)
    named = open_.join(labels, open_["node"] == labels["labelled"], "left").select("hub", "node", F.coalesce("component", "node").alias("label"))
    sketched = _cells(named, named.groupBy("hub").agg(F.count("*").alias("size")), "hub", BLOCK).join(_by_node(sets, "n", "sketch"), "node")
    near = settle_wide(_met(sketched, "hub").mapInArrow(_near_rows(num, den), "hub bigint, node bigint, label bigint").distinct())
    met = _cells(near, near.groupBy("hub").agg(F.count("*").alias("size")), "hub", TOKEN_BLOCK).join(_by_node(sets, "tokens"), "node")
    out = settle_wide(_met(met, "hub").mapInArrow(_links(num, den), "a bigint, b bigint").distinct())
    discard(sets)
    return out


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = (1, 2), marked: bool = False) -> DataFrame:
    """id, n_shingles, component_id of every row; ``k`` words a shingle, similarity ``num / den``.

    ``marked`` adds mark, the xxhash64 of the row's text, and component, which names the row's component also where ids repeat or are null (null for a row
    without tokens).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    texts, mark = (rows.withColumn("mark", F.xxhash64("text")), ["mark"]) if marked else (rows, [])
    schema = "counter int, id bigint, n bigint, s1 bigint, s2 bigint, hist binary" + (", mark bigint" if marked else "")
    profile = settle_wide(texts.mapInArrow(_profile(k, marked), schema))
    own = profile.filter("counter is null").select("id", "n", "s1", "s2", *mark)
    counters = np.zeros(COUNTERS, np.int64)
    for row in profile.filter("counter is not null").groupBy("counter").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counters[row.column("counter").to_numpy()] = row.column("n").to_numpy()
    usual = float(counters.mean())
    bounds = tuple(int((usual + 6 * usual**0.5 + 16) * 16**i) for i in range(len(sizes) - 1))
    shared = spark.sparkContext.broadcast(counters)
    sigs = rows.mapInArrow(_signatures(k, sizes, bounds, num, den, shared), "sig bigint, node bigint").repartition("sig").sortWithinPartitions("sig", "node")
    members = settle_wide(sigs.mapInArrow(members_of, "sig bigint, hub bigint, node bigint"))
    of_sets = profile.filter("counter is null and n > 0").groupBy("s1", "s2").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.first("hist").alias("hist"))
    nodes = settle(of_sets.withColumnRenamed("s1", "node"))
    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = _linked(settle(_filtered(stars, nodes, num, den)), rows, nodes, k, num, den)
    labels = components(links).select(F.col("node").alias("labelled"), "component")
    more = _open_links(members, labels, rows, nodes, k, num, den)
    final = components(links.union(more)) if more.limit(1).count() else labels.withColumnRenamed("labelled", "node")
    of_set = nodes.select(F.col("node").alias("s1"), "s2", "first").join(final.select(F.col("node").alias("s1"), "component"), "s1", "left")
    of_set = of_set.withColumn("component", F.coalesce("component", "s1"))
    least = of_set.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of_set.join(least, "component").select("s1", "s2", "component_id", *(["component"] if marked else []))
    out = own.join(named, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *((*mark, "component") if marked else ()))
