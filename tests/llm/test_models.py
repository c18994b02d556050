"""Models, fingerprints, top-k, mixing, packing and sharding against plain Python or held-out data."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import BASE, docs, odd_rows, words
from pyspark.sql import functions as F

from docspark.llm import fingerprint, language, mixing, packing, quality, sharding, topk


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- fingerprints --------------------------------------------------------------------------------------------
def test_likeness_is_generalised_jaccard():
    rng, tables = np.random.default_rng(2), fingerprint.variables(64, 1)
    for _ in range(5):
        terms = rng.choice(fingerprint.TERMS, 300, replace=False)
        a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = (fingerprint.sample(terms[a > 0], a[a > 0], tables) == fingerprint.sample(terms[b > 0], b[b > 0], tables)).mean()
        assert abs(same - want) < 0.22
    w = np.full(300, 3)
    assert (fingerprint.sample(terms, w, tables) == fingerprint.sample(terms[::-1], w, tables)).all()


def test_likeness_of_long_texts():
    """Terms of long texts do not meet by chance, and texts longer than a step agree as their word pairs do."""
    texts = [" ".join(f"{name}{i}" for i in range(200_000)) for name in "ab"]
    a, b, both, twice = fingerprint.fingerprints(pa.array([*texts, " ".join(texts), " ".join(texts[:1] * 2)]), 64, 1)
    assert fingerprint.likeness(a, b) < 0.05
    assert abs(fingerprint.likeness(a, both) - 0.5) < 0.22 and abs(fingerprint.likeness(a, twice) - 0.5) < 0.22
    assert fingerprint.likeness(b, twice) < 0.05


def test_samples_are_unbiased():
    """Over many samples the share of equal ones comes close to the generalised Jaccard similarity."""
    rng, tables = np.random.default_rng(3), fingerprint.variables(4096, 7)
    for n in (40, 3000):
        terms = rng.choice(fingerprint.TERMS, n, replace=False)
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = (fingerprint.sample(terms[a > 0], a[a > 0], tables) == fingerprint.sample(terms[b > 0], b[b > 0], tables)).mean()
        assert abs(same - want) < 0.04


def brute_edited(rows):
    order = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows))
    out = []
    for i, (doc, text) in enumerate(order):
        cut = len(text) // 4
        changed = text[: len(text) - cut] + order[(i + 1) % len(order)][1][:cut]
        out.append((None if doc == -(2**63) else doc, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts_follow_the_next_document(spark):
    many = [(i * 3 % 101, " ".join(random.Random(i).choices(BASE, k=i % 17)), "en", "a", 1) for i in range(101)]
    for rows in (odd_rows(), many, many[:1], []):
        got = fingerprint.edited(docs(spark, rows).repartition(3))
        assert rows_of(got, "doc_id", "n_chars", "edited_sha256") == brute_edited(rows)
    prints = {r.doc_id: r for r in fingerprint.edited(docs(spark, many)).collect()}
    by_text = defaultdict(set)
    for r in many:
        by_text[r[1]].add(prints[r[0]].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.likeness(prints[5].fingerprint, prints[5].fingerprint) == 1.0
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(docs(spark, many)).collect()}
    assert plain == {k: r.fingerprint for k, r in prints.items()}


# --- language ------------------------------------------------------------------------------------------------
def test_languages_and_mixtures(spark):
    rng = random.Random(6)
    tongues = {"xx": ["ka", "ti", "ro", "mu"], "yy": ["shl", "brn", "göt", "wef"], "zz": ["éa", "ou", "ieu", "ya"]}
    word = lambda t: "".join(rng.choices(tongues[t], k=rng.randint(1, 4)))
    rows = [(i, " ".join(word(t) for _ in range(40)), t, "s", 1) for i, t in enumerate(rng.choices(list(tongues), k=150))]
    model = language.fit(docs(spark, rows))
    assert model.languages == ["xx", "yy", "zz"]
    new = [(1000 + i, " ".join(word(t) for _ in range(12)), None, None, None) for i, t in enumerate(["xx", "yy", "zz"] * 10)]
    half = " ".join([word("xx") for _ in range(60)] + [word("zz") for _ in range(30)])
    odd = [(1, None, "xx", "s", 1), (2, "", "xx", "s", 1), (3, "12 -- !", "xx", "s", 1), (4, half, "yy", "s", 1), (None, "É", None, None, None), (6, half * 50, "xx", "s", 1)]
    got = {r.doc_id: r for r in language.predict(docs(spark, new + odd), model, ["doc_id", "name"]).collect()}
    assert all(got[1000 + i].lang_pred == t for i, t in enumerate(["xx", "yy", "zz"] * 10))
    assert [(got[i].lang_pred, got[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4].lang_pred == "xx" and abs(got[4].score - 2 / 3) < 0.08 and got[4].languages.count(":") == 2
    assert got[1000].languages.count(":") == 1 and got[6].lang_pred == "xx" and None in got
    assert language.predict(docs(spark, []), model, ["doc_id"]).collect() == []
    none = language.fit(docs(spark, [(1, "text", None, None, None)]))
    assert {(r.lang_pred, r.score) for r in language.predict(docs(spark), none, ["doc_id"]).collect()} == {("und", 0.0)}


def test_shares_reach_the_likelihood_optimum():
    """The rounds come close to the best shares on a grid."""
    rng = np.random.default_rng(0)
    weights = rng.random((50, 2)) ** 3 + 1e-3
    shares, likely = language.mixtures(weights, np.array([0, 50]), np.ones((1, 2)))
    grid = [np.log(weights @ np.array([p, 1 - p])).sum() for p in np.linspace(0.001, 0.999, 999)]
    assert likely[0] > max(grid) - 0.05 and abs(shares.sum() - 1) < 1e-9


def test_held_out_rules(spark):
    ids = spark.range(50).select("id", language.held_out(F.col("id")).alias("l"), quality.held_out(F.col("id")).alias("q")).collect()
    assert all(r.l == (zlib.crc32(str(r.id).encode()) % 4 == 2) and r.q == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)


# --- quality -------------------------------------------------------------------------------------------------
def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices(BASE, k=60))
    bad = lambda: " ".join(w + rng.choice(["***", "%%%", " |"]) for w in rng.choices(BASE, k=60))
    rows = [(i, good() if i % 3 else bad(), "en", "s", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (7, 9, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows + [r for r in odd_rows() if r[0] is None or r[1] is None]), labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 303 and len(held) > 30 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id is not None) >= 0.95 * len(held)
    assert {r.score for r in quality.classify(docs(spark), labels.filter("false")).collect()} == {0.5}
    assert quality.classify(docs(spark, []), labels).collect() == []


def test_isotonic_means_are_the_least_squares_fit():
    rng = np.random.default_rng(3)
    n, y = rng.integers(1, 5, 30), rng.random(30)
    got = quality.pooled(n, n * y)
    assert (np.diff(got) >= -1e-12).all() and abs((n * got).sum() - (n * y).sum()) < 1e-9
    # a block's mean cannot be bettered by splitting it: means of its heads are not below, of its tails not above
    for value in np.unique(got):
        at = np.flatnonzero(got == value)
        for cut in range(1, len(at)):
            assert np.average(y[at[:cut]], weights=n[at[:cut]]) >= value - 1e-9


# --- top-k ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("span", [1.0, 300.0])
def test_top_k(spark, monkeypatch, span):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 37)
    monkeypatch.setattr(topk, "BLOCKS_PER_GROUP", 2)
    monkeypatch.setattr(topk, "QUERIES_PER_GROUP", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.integers(-3, 4, 6) if i % 2 else rng.normal(size=6)) * span]) for i in range(230)]
    rows += [(1000 + i, rows[7][1]) for i in range(9)]  # ties
    odd = [(2000, None), (2010, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (2040, [1.0, 2.0]), (2050, []), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = rows_of(topk.top_k(topk.build_index(df), df.filter("vec_id % 10 = 0"), 5), "query_id", "rank", "vec_id", "score")
    ints = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in rows}
    items = list(ints.items()) + [(0, ints[0])]
    want = []
    for q in [i for i in ints if i % 10 == 0]:
        best = sorted((-int(ints[q] @ v), i) for i, v in items if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want, key=str)
    assert topk.top_k(topk.build_index(df.limit(0)), df.limit(0), 5).collect() == []


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)] + [(100, [1e7, 0.5, -1.0, 2.0]), (101, [-3e9, 1e12, 0.0, 1.0]), (102, [2.0**50, -(2.0**51), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(x) for x in np.floor(256 * np.array(v))] for i, v in rows}
    got = rows_of(topk.top_k(topk.build_index(df), df.filter("vec_id in (0, 7)").withColumn("embedding", F.transform("embedding", lambda x: x / 100)), 30), "query_id", "rank", "vec_id", "score")
    want = []
    for q in (0, 7):
        weights = [int(x) for x in np.floor(256 * (np.array(rows[q][1]) / 100))]
        best = sorted((-sum(a * b for a, b in zip(weights, v)), i) for i, v in ints.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want, key=str) and max(abs(r[3]) for r in got) >= 2**58
    for vector in ([1e17], [1e10]):  # a component and a score that do not fit
        one = spark.createDataFrame([(1, vector), (2, vector)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="does not fit a long"):
            topk.top_k(topk.build_index(one), one, 5).collect()
    # a score that does not fit is no reason to stop where better ones are the result
    low = spark.createDataFrame([(1, [1e10]), (2, [-1e10]), (3, [1e-2])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(topk.build_index(low), low.filter("vec_id = 1"), 1).collect()] == [(3, 2 * 2_560_000_000_000)]


def test_signed_digits():
    for weight in range(-70, 70):
        assert sum(sign << place for place, sign in topk.signed_digits(weight)) == weight


# --- mixing --------------------------------------------------------------------------------------------------
def filled(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while True:
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] >= 3 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
        rest -= sum(3 * sizes[s] for s in over)


@pytest.mark.parametrize("block", [7, 64])
def test_mixture(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 9)
    monkeypatch.setattr(mixing, "SLOTS_PER_CHUNK", 16)
    rng = random.Random(block)
    rows = odd_rows() + [(100 + i, " ".join(rng.choices(BASE, k=rng.randint(0, 60))), "en", rng.choice("aaaaaabcdefgh"), 1) for i in range(120)]
    df = docs(spark, rows)
    plan = mixing.mix(df, block=block)
    got = [r.asDict() for r in plan.taken().collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = filled(sizes)
    assert sorted((r["key"], r["size"]) for r in got if r["key"] is not None) == sorted((r[0], len(words(r[1]))) for r in rows if r[0] is not None)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    taken, source = Counter(), defaultdict(set)
    for r in plan.documents.collect():
        source[r.source_size, r.target].add(r.s)
    for s, size in sizes.items():
        mine = [r for r in got if r["source_size"] == size and abs(r["target"] - want[s]) < 1e-3]
        assert mine and len({(r["source_size"], r["target"]) for r in mine}) == 1
        n = len(source[mine[0]["source_size"], mine[0]["target"]])
        assert abs(sum(r["taken"] for r in mine) / n - want[s]) <= 1
        taken[s] += 1
    again = mixing.mix(df.repartition(5), block=block).taken()
    columns = ("key", "size", "source_size", "target", "taken")
    assert rows_of(again, *columns) == rows_of(plan.taken(), *columns)
    # the texts hold as many words as were taken, and whole passes keep the text
    texts = mixing.mixed_texts(df, plan)
    assert sum(len(words(r.text)) for r in texts.collect()) == sum(r["taken"] for r in got) and texts.columns == df.columns
    assert mixing.mix(docs(spark, [])).taken().collect() == []


# --- packing -------------------------------------------------------------------------------------------------
def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 4):
        lengths = np.sort(rng.choice(60, 9, replace=False) + 1)
        counts = rng.integers(1, 20, 9)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1].tolist(), k - 1))
        assert padding(lengths, counts, packing.choose_bounds(lengths, counts, k)) == best


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CELL", 5)
    rows = odd_rows() + [(100 + i, " ".join(BASE[:1] * (i * i % 700)), "en", "a", 1) for i in range(150)]
    got = packing.pack(docs(spark, rows), buckets=4, budget=600, keep=("lang",)).collect()
    assert sorted((r.n_words, r.lang or "") for r in got) == sorted((len(words(r[1])), r[2] or "") for r in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_words <= r.bound and r.padding == r.bound - r.n_words and (r.n_words > 0) == (r.bound > 0)
        batches[r.bucket, r.batch].append(r)
    buckets = defaultdict(set)
    for (bucket, batch), members in batches.items():
        buckets[bucket].add(batch)
        assert sorted(m.slot for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bound <= 600
    assert all(v == set(range(len(v))) for v in buckets.values())
    assert packing.pack(docs(spark, [])).collect() == []


def quadratic_padding(lengths, counts, buckets):
    """Least padding with at most so many buckets, by every split."""
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(buckets):
        cost = lambda i, j: sum(counts[x] * (lengths[j - 1] - lengths[x]) for x in range(i, j))
        best = [0] + [min(best[i] + cost(i, j) for i in range(j)) for j in range(1, len(lengths) + 1)]
    return best[-1]


def test_bounds_of_long_rows_are_optimal(spark):
    rng = np.random.default_rng(9)
    for _ in range(10):
        lengths = np.sort(rng.choice(5000, 40, replace=False) + 1)
        counts = rng.integers(1, 30, 40)
        for k in (1, 3, 7, 40, 50):
            bounds = packing.choose_bounds(lengths, counts, k)
            assert len(bounds) <= k and padding(lengths, counts, bounds) == quadratic_padding(lengths.tolist(), counts.tolist(), min(k, 40))
    long = [257] * 5 + [259] * 3 + [1001, 1003, 1003, 2000, 3333, 3334, 5001]
    got = packing.pack(docs(spark, [(i, "a " * n, "en", "a", 1) for i, n in enumerate(long)]), buckets=4).collect()
    lengths, counts = np.unique(long, return_counts=True)
    assert sum(r.padding for r in got) == quadratic_padding(lengths.tolist(), counts.tolist(), 4) and {r.bound for r in got} <= set(long)
    same = packing.pack(docs(spark, [(i, "a " * 257, "en", "a", 1) for i in range(9)])).collect()
    assert {(r.bound, r.padding) for r in same} == {(257, 0)}


def test_long_lengths_step_up(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 256, 257, 1000, 99999, 10**9)], "n long").select("n", packing.step_up(F.col("n")).alias("up")).collect()
    assert all(r.n <= r.up <= max(256, r.n * (1 + 1 / packing.STEPS)) and (r.n > 256 or r.n == r.up) for r in rows)


# --- sharding ------------------------------------------------------------------------------------------------
def plain_jump(key, shards):
    at, onward, k = -1, 0, 1
    while onward < shards:
        at = onward
        onward = int((at + 1) * 4294967296.0 / (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:8], 16) + 1))
        k += 1
    return at


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 7)
    rows = odd_rows() + [(100 + i, "x" * i, "en", "a", 1) for i in range(200)]
    got = sharding.assign(docs(spark, rows), shards).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.shard == plain_jump(key, shards) and r.grown_shard == plain_jump(key, shards + 1) and r.grown_shard in (r.shard, shards)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert sharding.assign(docs(spark, []), shards).collect() == []


def test_shard_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs(spark).drop("shard"), path, 4)
    assert spark.read.parquet(path).count() == len(odd_rows())
