"""The pipeline's stages against plain Python, each on what the one before kept."""

import random
from collections import Counter

from helpers import SCHEMA, docs, odd_rows, sentence, words
from test_dedup import brute_components, brute_lines, copies

import corpus_pipeline as pipeline
from docspark.session import settle


def test_stages(spark):
    rows = [(r[0], r[1], "en", "abc"[i % 3], len(r[1])) for i, r in enumerate(copies(random.Random(9), 80))] + [(500, None, None, None, None), (501, "12 -", "en", "a", 4), (502, "", "en", "a", 0)]
    kept = settle(pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), ""))
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if r[0] < 500]
    lines = settle(pipeline.dedup_lines(spark, kept, ""))
    want = {r[0]: r[3] for r in brute_lines([tuple(r) for r in kept.collect()]) if words(r[3])}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    single = settle(pipeline.join_near_copies(spark, lines, ""))
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in brute_components([tuple(r) for r in lines.collect()], 5, 80, 100) if d == c)
    mixed = settle(pipeline.mix_sources(spark, single, ""))
    had, got = {r.doc_id: words(r.text) for r in single.collect()}, mixed.collect()
    total = sum(len(w) for w in had.values())
    assert abs(sum(len(words(r.text)) for r in got) - total) <= 3 and max(Counter(r.doc_id for r in got).values()) <= 3
    assert all(not Counter(words(r.text)) - Counter(had[r.doc_id]) for r in got)
    packed = pipeline.pack_batches(spark, mixed, "").collect()
    assert sorted((r.doc_id, r.n_words) for r in packed) == sorted((r.doc_id, len(words(r.text))) for r in got)
    assert all(df.columns == kept.columns for df in (lines, single, mixed))


def test_language_id_keeps_what_learned_languages_explain(spark):
    rng = random.Random(4)
    tongues = {"xx": ["ka", "ti", "ro", "mu"], "yy": ["shl", "brn", "göt", "wef"], "zz": ["éa", "ou", "ieu", "ya"]}
    word = lambda t: "".join(rng.choices(tongues[t], k=rng.randint(1, 4)))
    rows = [(i, " ".join(word(t) for _ in range(40)), t, "s", 1) for i, t in enumerate(rng.choices(list(tongues), k=150))]
    mixed = " ".join([word("xx") for _ in range(40)] + [word("yy") for _ in range(30)] + [word("zz") for _ in range(30)])
    odd = [(900, mixed, None, "s", 1), (901, "Ψξφ ΩΔΘ ЖЩЮ жщю", None, "s", 1), (902, "12 -", None, "s", 1), (903, None, "xx", "s", 1)]
    got = {r.doc_id: r.lang for r in pipeline.language_id(spark, spark.createDataFrame(rows + odd, SCHEMA), "").collect()}
    assert set(got) == {r[0] for r in rows} | {900} and got[900] == "xx"
    unknown = [(r[0], r[1], None, "s", 1) for r in rows + odd]
    plain = pipeline.language_id(spark, spark.createDataFrame(unknown, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in plain) == sorted({r[0] for r in rows} | {900, 901}) and {r.lang for r in plain} == {"und"}


def test_one_row_of_each_group_stays(spark):
    a, near, b, c, d = sentence(0, 60), sentence(0, 60, p59="x"), sentence(60, 120), sentence(20, 80), " ".join(f"z{i}" for i in range(40))
    texts = [(1, a), (1, a), (2, near), (2, b), (2, b), (None, near), (None, c), (None, c), (None, d), (None, f"{d} y"), (4, f"{d} y"), (5, ""), (5, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], SCHEMA)
    got = pipeline.join_near_copies(spark, df.repartition(3), "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (4, f"{d} y"), (5, ""), (5, ""), (None, None)], key=str)
    assert got.columns == df.columns


def test_odd_and_empty_tables(spark):
    for rows in (odd_rows(), []):
        df = docs(spark, rows)
        for _, stage in pipeline.STAGES:
            df = settle(stage(spark, df, ""))
        assert "batch" in df.columns and (df.count() > 0) == bool(rows)
