"""Joins and deduplication against plain Python."""

import hashlib
import random

import pytest
from helpers import BASE, SCHEMA, ascii_lower, docs, odd_rows, words

from docspark.llm import line_dedup, ngram_join, substring
from docspark.llm.components import components


def copies(rng, n=120):
    """Documents of a few families: copies, near copies with edits, fresh ones, and a passage that many share."""
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(70)]
    families = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 150))] for _ in range(12)]
    out = []
    for i in range(n):
        body = list(rng.choice(families)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            at = rng.randrange(len(body))
            body[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], [rng.choice(vocabulary)]])
            body = body or ["x"]
        if rng.random() < 0.3:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        lines = [" ".join(body[j : j + 20]) for j in range(0, len(body), 20)]
        out.append((i, "\n".join(lines), "en", "s", 1))
    return out


def shingles(text, k):
    ws = words(ascii_lower(text))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute_components(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(top(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("k,num,den,sizes", [(3, 90, 100, (1, 2)), (5, 80, 100, (1, 2)), (2, 50, 100, (1, 2)), (3, 70, 100, (1, 2, 3))])
def test_components_of_similar_texts(spark, monkeypatch, k, num, den, sizes):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    for rows in (odd_rows(), copies(random.Random(k * num))):
        got = [tuple(r) for r in ngram_join.join(docs(spark, rows), k, num, den, sizes=sizes).collect()]
        assert sorted(got, key=str) == brute_components(rows, k, num, den)


def test_every_token_frequent(spark):
    """All tokens are indexed as combinations when the limits say so, and nothing is lost."""
    import numpy as np

    rng = random.Random(4)
    rows = copies(rng, 80)
    sets = [np.array(sorted(hash(x) & (2**63 - 1) for x in shingles(r[1], 3)), np.uint64) for r in rows]
    for sizes, bounds in (((1, 2), (-1,)), ((1, 2, 3), (-2, -1)), ((1, 3), (-1,))):
        for num in (50, 80, 90):
            made = ngram_join.Prefixes(np.zeros(64, np.int64), sizes, bounds, num, 100)
            signed = [set(made.signatures(s).tolist()) if len(s) else set() for s in sets]
            for i, a in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(a, sets[j]))
                    if both and not np.array_equal(a, sets[j]) and 100 * both >= num * (len(a) + len(sets[j]) - both):
                        assert signed[i] & signed[j]


def test_members_of_signatures():
    """Groups of several nodes, each node once, wherever the batches end."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    for size in (1, 2, 3, 7, 1000):
        rows = sorted((rng.randrange(-40, 40), rng.choice([-5, -1, 0, 3, 9])) for _ in range(150))
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows[i : i + size])], names=["sig", "node"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in ngram_join.members_of(iter(batches)) for r in b.to_pylist()]
        nodes = {}
        for sig, node in rows:
            nodes.setdefault(sig, set()).add(node)
        assert sorted(got) == sorted((sig, min(of), node) for sig, of in nodes.items() if len(of) > 1 for node in of)


def test_sketches_of_long_sets():
    """A sketch's distance never exceeds the difference of two sets, and long sets that are far apart do not pass as 64 counters let them."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for n in (1, 40, 257, 1000, 1025, 9000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0, 0.5, 0.89, 0.95, 1):
            y = np.unique(np.append(x[: int(n * share)], rng.integers(0, 2**64, n - int(n * share) + rng.integers(0, n // 9 + 1), dtype=np.uint64)))
            gap = ngram_join.sketch_gap(*(np.frombuffer(ngram_join.sketch(s), np.uint8).astype(np.int16) for s in (x, y)))
            assert gap <= len(np.setxor1d(x, y))
    sets = [np.unique(rng.integers(0, 2**64, 9000, dtype=np.uint64)) for _ in range(6)]
    sets.append(np.delete(sets[0], slice(0, 300)))
    columns = {"hub": [1] * 7, "i": [0] * 7, "j": [0] * 7, "node": range(7), "label": range(7), "n": [len(s) for s in sets], "side": [0] * 7}
    table = pa.table({c: pa.array(np.array(v, np.int64)) for c, v in columns.items()}).append_column("sketch", pa.array([ngram_join.sketch(s) for s in sets]))
    table = table.append_column("hist", pa.array([ngram_join.histogram(s) for s in sets])).append_column("sig", table.column("hub"))
    passed = {f: sorted(x for b in run(90, 100)(iter(table.to_batches())) for x in b.column("node").to_pylist()) for f, run in (("hist", ngram_join._open_rows), ("sketch", ngram_join._near_rows))}
    assert passed == {"hist": list(range(7)), "sketch": [0, 6]}


def test_components_of_long_texts(spark, monkeypatch):
    """Sets of 200 to 2500 shingles on both sides of the bound, in groups of several components; ids and rows repeat."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(21)
    rows = []
    for length in (200, 500, 1000, 2500):
        base = [f"l{rng.randrange(3000)}" for _ in range(length)]
        for i in range(14):
            body = base + [f"m{rng.randrange(3000)}" for _ in range(rng.randrange(length // 12 + 1))]
            for at in rng.sample(range(length), length * rng.choice([0, 1, 2, 3, 4]) // 100):
                body[at] = f"n{rng.randrange(3000)}"
            rows += [(rng.randrange(60), " ".join(body), "en", "s", 1)] * rng.choice([1, 1, 3])
    rows += [(None, r[1], "en", "s", 1) for r in rows[:5]]
    got = [tuple(r) for r in ngram_join.join(docs(spark, rows), 3, 90, 100).collect()]
    assert sorted(got, key=str) == brute_components(rows, 3, 90, 100)


def test_signatures_are_shuffled_once(spark, monkeypatch):
    """Neither the signatures nor the token sets are written or shuffled before what meets no partner is gone."""
    written, real = [], ngram_join.settle_wide
    monkeypatch.setattr(ngram_join, "settle_wide", lambda df: written.append((df.columns, real(df))) or written[-1][1])
    rows = copies(random.Random(11))
    assert ngram_join.join(docs(spark, rows), 3, 90, 100).count() == len(rows)
    assert not any(set(columns) == {"sig", "node"} for columns, _ in written)
    sets = [table for columns, table in written if "tokens" in columns]
    assert sets and all("sketch" in table.columns for table in sets)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert ngram_join.join(none).collect() == []
    assert substring.deduplicate(none).collect() == []
    assert line_dedup.deduplicate(none).collect() == []


def test_connected_components(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(50)], [(5, 5)]):
        parent = {x: x for e in edges for x in e}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
        want = {(x, top(x)) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def brute_substrings(rows, length):
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    first = {}
    for i, r in zip(ids, rows):
        ws = words(r[1])
        for s in range(len(ws) - length + 1):
            key = tuple(ws[s : s + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, r in zip(ids, rows):
        ws = words(r[1])
        gone = {p for s in range(len(ws) - length + 1) if first[tuple(ws[s : s + length])] < i for p in range(s, s + length)}
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((r[0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 20, 7])
def test_substrings(spark, length):
    for rows in (odd_rows(), copies(random.Random(length))):
        got = substring.deduplicate(docs(spark, rows), length).drop("changed_text").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_substrings(rows, length)


def test_stretches_with_a_repeated_run(spark):
    """Texts that repeat themselves, so that stretches of one name differ."""
    a = BASE[:10] * 12
    rows = [(1, " ".join(a), "en", "s", 1), (2, " ".join(BASE[50:60] + a[3:100]), "en", "s", 1), (3, " ".join(a[5:70] + BASE[30:50]), "en", "s", 1), (0, " ".join(a[:55]), "en", "s", 1)]
    got = substring.deduplicate(docs(spark, rows)).drop("changed_text").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substrings(rows, 50)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows):
    order = []
    for n, r in enumerate(rows):
        for pos, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            order.append((-(2**63) if r[0] is None else r[0], pos, n, words(line)))
    out = []
    for n, r in enumerate(rows):
        if r[1] is None:
            out.append((r[0], 0, 0, None))
            continue
        lines, kept = r[1].split("\n"), []
        own = -(2**63) if r[0] is None else r[0]
        for pos, line in enumerate(lines):
            ws = words(line)
            near = lambda o: o == ws or (len(o) >= 8 and len(ws) >= 8 and one_edit(o, ws))  # noqa: E731, B023
            if not ws or not any((i, p) < (own, pos) and near(o) for i, p, m, o in order):
                kept.append(line)
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "STRIDE", 4)
    rng = random.Random(3)
    long = [f"q{i}" for i in range(300)]
    edited = [(500 + i, "\n".join(" ".join(long[:p] + put + long[p + cut :]) for p, put, cut in [(rng.randrange(300), *rng.choice([(["z"], 1), (["z"], 0), ([], 1), (["y"], 1)])) for _ in range(4)]), "en", "s", 1) for i in range(10)]
    unique_ids = [r for r in odd_rows() if r[0] not in (2, None)]
    for rows in (unique_ids, copies(rng), edited):
        got = line_dedup.deduplicate(docs(spark, rows)).select("doc_id", "n_lines", "n_removed", "text").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)


def test_lines_of_repeated_rows(spark):
    """Rows with equal id and text are one document: both keep what the first keeps. Extra columns stay."""
    got = line_dedup.deduplicate(docs(spark)).filter("doc_id = 2 and text = ''").collect()
    assert len(got) == 2 and got[0]["mark"] == "clash"
    assert line_dedup.deduplicate(spark.createDataFrame([(1, "a\n\nb\na", "x", "y", 1)], SCHEMA)).first()["text"] == "a\n\nb"
