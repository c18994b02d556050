"""Synchronisation, history, breaker, cache and report jobs on small inputs."""

import bisect
import hashlib
import random
import time
import types
import unicodedata
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark import schemas
from docspark.operators import answers, evidence, quality, sync, usage
from docspark.operators.search_index import SearchIndex
from docspark.session import scratch_path
from docspark.sources import files, tables
from docspark.streaming import outcomes

NOW, OLD = P.CHUNKER_VERSION, P.LEGACY_VERSION


def record(path, mtime=1.0, sha="s", size=10, version=NOW, indexed=True, missing=False):
    return (path, mtime, sha, size, version, P.EMBEDDER_VERSION, 1, "법률", 1, indexed, None, missing)


def test_change_classes(spark):
    listing = [("/same", 1.0, 10), ("/touched", 9.0, 10), ("/edited", 9.0, 10), ("/new", 1.0, 10), ("/stale", 1.0, 10), ("/off", 1.0, 10), ("/hidden", 1.0, 10)]
    manifest = [
        record("/same"), record("/touched"), record("/edited"), record("/gone"), record("relative"), record("/lost", missing=True),
        record("/stale", version=OLD), record("/off", indexed=False), record("/hidden"),
    ]
    on_disk = spark.createDataFrame(listing, "path string, mtime double, size_bytes bigint")
    known = spark.createDataFrame(manifest, schemas.MANIFEST)
    shas = {"/touched": "s", "/edited": "other", "/hidden": "other"}
    hashes = spark.createDataFrame([(p, shas.get(p, "s")) for p, _, _ in listing], "path string, sha256 string")
    needed = {r.path for r in sync.touched(on_disk, known).collect()}
    assert needed == {"/touched", "/edited"}
    got = {r.path: r.change for r in sync.classify(on_disk, known, hashes.filter(F.col("path").isin(*needed))).collect()}
    assert got == {
        "/same": "unchanged", "/touched": "unchanged", "/edited": "modified", "/new": "added", "/gone": "deleted", "/stale": "stale_code", "/off": "skipped",
        "/hidden": "unchanged",
    }


def test_a_failed_file_keeps_its_chunks(spark):
    changes = spark.createDataFrame([("/a", "modified"), ("/b", "modified"), ("/c", "deleted"), ("/d", "modified")], "path string, change string")
    status = spark.createDataFrame([("/a", "ok"), ("/b", "error"), ("/d", "parse_empty")], "path string, status string")
    old = spark.createDataFrame([(p, "old") for p in ("/a", "/b", "/c", "/d", "/e")], "path string, text string")
    new = spark.createDataFrame([("/a", "new"), ("/b", "new")], "path string, text string")
    got = {tuple(r) for r in sync.apply_chunks(changes, old, new, status).collect()}
    assert got == {("/a", "new"), ("/b", "old"), ("/e", "old")}


def test_history_slices_before_it_filters(spark):
    turns = [(1, i, "user", f"질문 {i}") for i in range(20)] + [(2, 0, "system", "x"), (2, 1, "assistant", "a" * 5000), (2, 2, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): r.history for r in evidence.history(df, P.HISTORY_PROMPT).collect()}
    assert got[1, 19].count(P.USER_TURN) == 6 and "질문 13" in got[1, 19] and "질문 12\n" not in got[1, 19]
    assert got[2, 2] == P.ASSISTANT_TURN + "a" * 1200 + "…" and got[2, 1] == ""


def calls(*marks):
    start = datetime(2024, 1, 1)
    return [(1, i, start + timedelta(seconds=s), ok) for i, (s, ok) in enumerate(marks)]


def test_failure_runs(spark):
    marks = [(i, False) for i in range(4)] + [(4, True)] + [(5 + i, False) for i in range(5)] + [(20, True), (90000, False), (180000, False), (180001, True)]
    df = spark.createDataFrame(calls(*marks), "channel bigint, event_id bigint, ts timestamp, ok boolean")
    got = sorted((r.first_ts, r.n_failures, r.trips) for r in outcomes.failure_runs(df).collect())
    assert [g[1:] for g in got] == [(4, False), (5, True), (2, False)] and got[2][0] == datetime(2024, 1, 1) + timedelta(seconds=90000)


def test_a_file_that_arrives_again_replaces_its_chunks(spark, tmp_path):
    from docspark.streaming import ingest

    schema = "source_file string, doc_name string, doc_type string, pages array<struct<page_num:int,text:string>>"
    for text in ("제1조(목적)\n" + "가" * 200, "제1조(목적)\n" + "나" * 200 + "\n제2조(정의)\n" + "다" * 200):
        docs = spark.createDataFrame([("a.pdf", "혁신법", "법률", [(1, text)])], schema)
        ingest.upsert_documents(docs, str(tmp_path / "table"))
    ingest.upsert_documents(spark.createDataFrame([("b.pdf", "혁신법", "법률", [(1, text)])], schema), str(tmp_path / "table"))
    rows = SearchIndex(spark, str(tmp_path / "table")).chunks().collect()
    assert sorted((r.source_file, r.article_no) for r in rows) == [(f, a) for f in ("a.pdf", "b.pdf") for a in ("제1조(목적)", "제2조(정의)")] and "가" * 50 not in "".join(r.text for r in rows)


def test_answers(spark):
    good = '{"verdict": "가능", "summary": "a {\\"} b", "citations": [], "follow_up_needed": false, "follow_up_questions": [], "risk_notes": []}'
    rows = [(1, "말 ```json\n" + good + "\n```"), (2, "x " + good + " y}"), (3, "없음"), (4, good.replace("가능", "글쎄")), (5, "")]
    first = spark.createDataFrame([(i, "법", "제1조", 3, "가" * 80) for i in (1, 2, 4)], "question_id bigint, doc_name string, article_no string, page int, text string")
    got = {r.question_id: r for r in answers.parse_answers(spark.createDataFrame(rows, "question_id bigint, response string"), first).collect()}
    assert got[1].error is None and got[1].citations[0].quote == "가" * 50 and got[2].summary == 'a {"} b'
    assert (got[3].error, got[4].error, got[5].error) == ("no_object", "bad_verdict", "empty")


def test_zero_confidence_falls_in_no_bin(spark):
    audit = spark.createDataFrame([(c,) for c in (0.0, 50.0, 50.1, 100.0)], "confidence double")
    got = {r.bin: r.n for r in usage.confidence_histogram(audit).collect()}
    assert got == {"~50%": 1, "50-60%": 1, "60-70%": 0, "70-80%": 0, "80-90%": 0, "90-100%": 1}


def test_page_ranges_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAGE_STRETCH", 4)
    pages = [1, 2, 3, 4, 5, 8, 10, 11, 12, 13, 20]
    df = spark.createDataFrame([("f", p) for p in pages], "source_file string, page_num bigint")
    got = sorted((r.first_page, r.last_page) for r in quality.page_ranges(df).collect())
    assert got == [(1, 5), (8, 8), (10, 13), (20, 20)]


def test_adjacent_keywords(spark):
    rows = [("f", str(i), f"별표 1 (part {i}/12)", t) for i, t in ((1, "-"), (2, "가중"), (10, "감경"), (3, "감경"))]
    df = spark.createDataFrame(rows, "source_file string, chunk_id string, article_no string, text string")
    got = quality.adjacent_keywords(df, *P.ADJACENT_WORDS).first()
    assert (got.first_at, got.second_at, got.adjacent) == (1, 2, True)


def test_scan_files(spark, tmp_path):
    for name, size in (("a.pdf", 2000), ("b.txt", 2000), ("c.HWP", 1000), ("d.pdf", 999), ("chunks/e.pdf", 2000)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * size)
    got = {r.path.rsplit("/", 1)[1]: r.size_bytes for r in files.scan_files(spark, [str(tmp_path), str(tmp_path)]).collect()}
    assert got == {"a.pdf": 2000, "c.HWP": 1000}


def test_only_touched_files_are_read(spark, tmp_path):
    """Two of four files are hashed; one of the others cannot be read, which would end the job if it were opened by the scan."""
    held = {"a.pdf": b"a" * 3_000_000, "b.pdf": b"b", "c.pdf": b"cc", "가.pdf": b"k"}
    for name, content in held.items():
        (tmp_path / unicodedata.normalize("NFD", name)).write_bytes(content)
    touched = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.pdf", "c.pdf", "가.pdf", "gone.pdf")], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in files.hash_files(spark, [str(tmp_path)], touched).collect()}
    assert got == {n: (len(held[n]), hashlib.sha256(held[n]).hexdigest()) for n in ("a.pdf", "c.pdf", "가.pdf")}
    opened, real = [], files.fs.FileSystem.from_uri
    batch = pa.RecordBatch.from_pydict({"path": ["x", "y"], "raw_path": [f"file:{tmp_path}/b.pdf", f"{tmp_path}/none"]})
    files.fs = types.SimpleNamespace(FileSystem=types.SimpleNamespace(from_uri=lambda uri: opened.append(uri) or real(uri)))
    try:
        rows = next(files.digests(iter([batch]))).to_pylist()
    finally:
        files.fs = pyarrow.fs
    assert [r["size_bytes"] for r in rows] == [1, None] and len(opened) == 2


def test_offsets_of_many_pages(spark):
    """Running starts and page lookups of long documents are those of short ones, and take a time in proportion (nearly) to the pages."""
    from docspark.functions import text as X

    def timed(n):
        rng = random.Random(n)
        lengths = [rng.randint(0, 50) for _ in range(n)]
        starts = [0]
        for length in lengths:
            starts.append(starts[-1] + length + 1)
        asked = [rng.randint(-5, starts[-1] + 5) for _ in range(n)]
        bounds = [(s, i + 10) for i, s in enumerate(starts[:-1])]
        df = spark.createDataFrame([(lengths, bounds, asked)], "lengths array<int>, bounds array<struct<start:int,page_num:int>>, asked array<int>").cache()
        df.count()
        begun = time.time()
        row = df.select(X.running_starts(F.col("lengths"), 1).alias("starts"), F.transform("asked", lambda o: X.offset_to_page(o, F.col("bounds"))).alias("pages")).first()
        spent = time.time() - begun
        assert row.starts == starts
        assert row.pages == [10 + max(bisect.bisect_right(starts[:-1], o) - 1, 0) if o >= 0 else 1 for o in asked]
        return spent

    for n in (1, 31, 32, 33, 34, 64, 100):
        timed(n)
    timed(5000)
    assert timed(20000) < 12 * max(timed(5000), 0.2)


def test_missing_index_reads_empty(spark):
    assert tables.scan_index(spark, scratch_path(spark, "nowhere")).count() == 0


def test_page_cache_default_name(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n"source_file": null, "pages": [{"page_num": 1, "text": "가"}]}', encoding="utf-8")
    got = tables.load_pages_json(spark, str(tmp_path), "stem.pdf").first()
    assert got.source_file == "stem.pdf" and got.pages[0].text == "가"


@pytest.mark.parametrize("force,want", [(False, {"b"}), (True, {"a", "b"})])
def test_pending(spark, force, want):
    both = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r.path for r in sync.pending(both, both.filter("path = 'a'"), force).collect()} == want


def test_history_counts_positions(spark, monkeypatch):
    """Turn numbers with gaps, over several stretches."""
    from docspark.operators import evidence

    monkeypatch.setattr(evidence, "TURN_STRETCH", 7)
    turns = spark.createDataFrame([(1, t, "user", f"q{t}") for t in (0, 5, 10, 15)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.history for r in evidence.history(turns, (2, 100, 100, "…")).collect()}
    assert got[0] == "" and [got[10].count("q0"), got[10].count("q5")] == [1, 1] and "q0" not in got[15] and "q10" in got[15]


def test_numbers_of_any_length(spark):
    from docspark.functions.text import part_number
    from docspark.operators import evaluate

    row = spark.createDataFrame([("제1조 (part 12345678/99999999)",), ("제1조",)], "label string").select(part_number(F.col("label")).alias("n")).collect()
    assert [r.n for r in row] == [12345678, 0]
    hit = spark.createDataFrame([("page_equals", "12345678", 12345678, "", "", "", 0.5)], "kind string, arg string, page long, article_no string, text string, doc_name string, score double")
    assert hit.select(evaluate.holds().alias("ok")).first().ok


def test_all_laws_and_cases_without_latency(spark):
    from docspark.operators import evaluate, evidence

    names = spark.range(1).select(evidence.law_names(F.lit("질문"), F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.concat(F.lit("법"), i.cast("string")))).alias("n")).first().n
    assert len(names) == 1500
    a = spark.createDataFrame([(1, True, 4.0), (2, True, None)], "case_id long, passed boolean, latency_ms double")
    summary = evaluate.ab_summary(evaluate.compare(a, a)).first()
    assert summary.n_cases == 2 and summary.a_mean_ms == 4.0
