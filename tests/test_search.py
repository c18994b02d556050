"""Retrieval parts against brute force on small inputs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.functions import questions as Q
from docspark.functions import tokens as T
from docspark.operators import bm25, dense, matching, needles
from docspark.operators import hints as H
from docspark.operators import retrieve as R


def test_pool_is_an_ordered_fold(spark):
    rows = [(1, i + 1, 0, 0, "c", s) for i, s in enumerate((0.5, 0.5, 0.5, 0.53))]
    got = R.pool(spark.createDataFrame(rows, "question_id bigint, step int, seq int, sub int, chunk_id string, score double")).first()
    assert got.score == pytest.approx(0.56) and got.n_sources == 4


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    items = [(f"i{n:03d}", [float(x) for x in rng.normal(size=8)]) for n in range(90)]
    items += [("zero", [0.0] * 8), ("twin", items[0][1])]
    asked = [(n, [float(x) for x in rng.normal(size=8)]) for n in range(7)]
    return items, asked


def nearest(items, question, k):
    def cos(a, b):
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / norm), 6) if norm else 0.0

    return sorted(((-cos(question, v), i) for i, v in items))[:k]


@pytest.mark.parametrize("limit", [dense.BROADCAST_BYTES, 0])
def test_top_k_equals_brute_force(spark, vectors, monkeypatch, limit):
    monkeypatch.setattr(dense, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(dense, "QUESTION_BLOCK", 3)
    items, asked = vectors
    got = dense.top_k(
        spark.createDataFrame(asked, "question_id bigint, embedding array<double>"),
        spark.createDataFrame(items, "chunk_id string, embedding array<double>"), 5,
    ).collect()
    for q, v in asked:
        mine = [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r["rank"])]
        assert mine == [n[1] for n in nearest(items, v, 5)]


def test_top_k_within_equals_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(dense, "ITEM_BLOCK", 10)
    monkeypatch.setattr(dense, "QUESTION_BLOCK", 2)
    items, asked = vectors
    sets = {"a": [i for i, _ in items], "b": [i for i, _ in items[::3]]}
    members = [(s, i) for s, ids in sets.items() for i in ids]
    wanted = [(s, f"{q}:{s}", v) for q, v in asked for s in sets]
    got = dense.top_k_within(
        spark.createDataFrame(wanted, "s string, asked string, embedding array<double>"), spark.createDataFrame(members, "s string, chunk_id string"),
        spark.createDataFrame(items, "chunk_id string, embedding array<double>"), ["s"], 4,
    ).collect()
    for s, key, v in wanted:
        mine = [r.chunk_id for r in sorted((r for r in got if r.asked == key), key=lambda r: r["rank"])]
        assert mine == [n[1] for n in nearest([x for x in items if x[0] in set(sets[s])], v, 4)]


def test_members_of_many_sets_are_shuffled_once(spark, vectors, monkeypatch):
    """Vectors meet the numbers of their sets and are packed where they lie; the salted way gives the same rows."""
    monkeypatch.setattr(dense, "ITEM_BLOCK", 7)
    items, asked = vectors
    members = spark.createDataFrame([(str(s), i) for s in range(12) for n, (i, _) in enumerate(items) if n % 12 >= s], "s string, chunk_id string")
    wanted = spark.createDataFrame([(str(s), f"{q}:{s}", v) for q, v in asked for s in range(13)], "s string, asked string, embedding array<double>")
    rows = spark.createDataFrame(items, "chunk_id string, embedding array<double>")
    near = dense.top_k_within(wanted, members, rows, ["s"], 4)
    assert "collect_list(struct(chunk_id" not in near._jdf.queryExecution().optimizedPlan().toString().replace("#", "")
    got = sorted(map(tuple, near.select("asked", "chunk_id", "rank").collect()))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    assert got == sorted(map(tuple, dense.top_k_within(wanted, members, rows, ["s"], 4).select("asked", "chunk_id", "rank").collect())) and len(got) == 7 * 12 * 4


@pytest.mark.parametrize("chars", [needles.GROUP_CHARS, 4000])
def test_many_overlapping_needles(spark, monkeypatch, chars):
    """5,000 needles, many inside one another, in one group and in several."""
    monkeypatch.setattr(needles, "GROUP_CHARS", chars)
    rng = random.Random(5)
    hays = ["".join(rng.choice("ab가나") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "가" * 300]
    asked = {"".join(rng.choice("ab가나") for _ in range(rng.randint(1, 9))) for _ in range(20000)}
    assert len(asked) > 5000
    h = spark.createDataFrame([(x,) for x in hays] + [(None,)], "hay string")
    n = spark.createDataFrame([(x,) for x in asked] + [("",)], "needle string")
    want = {(a, b) for a in hays for b in asked if b in a}
    got = [tuple(r) for r in matching.contains_join(h, n).collect()]
    assert len(got) == len(want) and set(got) == want
    assert matching.contains_join(h, n.limit(0)).count() == 0


def test_phrases_need_every_token(spark):
    chunks = spark.createDataFrame([("1", "연구활동비를 사용한다"), ("2", "연구활동비"), ("3", "사용 A/B 시험"), ("4", "A B 시험 ※ ★")], "chunk_id string, text string")
    phrases = spark.createDataFrame([("연구활동비 사용",), ("A/B",), ("시험",), ("※ ★",), ("※ ☆",), ("시험 ★",), ("",), ("없는 시험",)], "phrase string")
    got = {tuple(r) for r in matching.phrase_matches(chunks, matching.word_index(chunks), phrases).collect()}
    assert got == {("연구활동비 사용", "1"), ("A/B", "3"), ("시험", "3"), ("시험", "4"), ("※ ★", "4"), ("시험 ★", "4")}


def test_the_rarest_word_proposes(spark, monkeypatch):
    """A phrase with a word in every second chunk is looked up in the chunks of its rare word only."""
    chunks = spark.createDataFrame([(str(i), ("공통 " if i % 2 else "") + f"단어{i % 50} 끝") for i in range(1000)], "chunk_id string, text string")
    phrases = spark.createDataFrame([("공통 단어7",), ("단어8 공통",)], "phrase string")
    got = matching.phrase_matches(chunks, matching.word_index(chunks), phrases).collect()
    assert {(r.phrase, int(r.chunk_id) % 50) for r in got} == {("공통 단어7", 7)} and len(got) == 20
    monkeypatch.setattr(matching.F, "forall", lambda column, check: F.lit(True))  # every proposed chunk passes
    assert matching.phrase_matches(chunks, matching.word_index(chunks), phrases).count() == 40


def test_label_does_not_match_a_branch_article(spark):
    chunks = spark.createDataFrame([("1", "제15조"), ("2", "제15조의2"), ("3", "제15조(목적) (part 1/2)"), ("4", "별표 2")], "chunk_id string, article_no string")
    needles = spark.createDataFrame([("제15조",), ("제15조의2",), ("별표 2",)], "needle string")
    got = {tuple(r) for r in matching.label_matches(chunks, needles).collect()}
    assert got == {("제15조", "1"), ("제15조", "3"), ("제15조의2", "2"), ("별표 2", "4")}


def test_tokens_are_those_of_the_expressions(spark):
    """The batch functions against Spark's own expressions: odd letters, particles, nulls, and a term of every count."""
    texts = ["", " ", None, "\u212aelvin İstanbul ÀB straße", "혁신법에서는 연구개발비를 ABC는 Ab제3조의 에서는 가에서는 비용은요 사용자는", "x yy YY zzz " * 40, "가나다라마는 가나다는\n부터까지 기관으로부터"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shorter = lambda w: F.regexp_replace(w, T.LONG_PARTICLE, "$1")
    stripped = lambda w: F.when(shorter(w) != w, shorter(w)).otherwise(F.regexp_replace(w, T.SHORT_PARTICLE, "$1"))
    normal = F.transform(T.words(F.col("t")), lambda w: F.when(F.regexp_like(w, F.lit("[가-힣]")), stripped(w)).otherwise(F.lower(w)))
    hashed = lambda t: F.conv(F.left(F.md5(t.cast("binary")), F.lit(4)), 16, 10).cast("int") % 64
    plain = rows.select("i", F.filter(normal, lambda t: F.length(t) >= 2).alias("tokens")).select("i", "tokens", F.transform("tokens", hashed).alias("buckets"))
    made = rows.select("i", T.index_tokens(F.col("t")).alias("got"), T.token_buckets(F.col("t"), 64).alias("places"), T.counted_tokens(F.col("t")).alias("c"))
    for r in plain.join(made, "i").collect():
        assert r.got == (r.tokens or []) and r.places == (r.buckets or []) and r.c.doc_len == len(r.got)
        assert [tuple(t) for t in r.c.terms] == sorted((t, r.got.count(t)) for t in set(r.got))


def test_a_worker_keeps_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(T, "KEPT_WORDS", 3)
    kept = T._Kept(str.upper)
    assert [kept[x] for x in "abcdabcd"] == list("ABCDABCD") and len(kept) <= 3


def test_tokens(spark):
    text = "연구활동비를 사용용도 Budget 매뉴얼에서는 A 3D프린터는"
    got = spark.createDataFrame([(text,)], "t string").select(T.index_tokens(F.col("t")).alias("k")).first().k
    assert got == ["연구활동비", "사용용도", "budget", "매뉴얼", "3D프린터"]


@pytest.mark.parametrize("limit", [bm25.BROADCAST_BYTES, 0])
def test_bm25_formula(spark, monkeypatch, limit):
    monkeypatch.setattr(bm25, "BROADCAST_BYTES", limit)
    texts = ["alpha beta beta", "alpha gamma", "alpha delta delta delta", "beta"]
    chunks = spark.createDataFrame([(str(i), t, "", "") for i, t in enumerate(texts)], "chunk_id string, text string, article_no string, article_title string")
    index = bm25.chunk_terms(chunks)
    questions = spark.createDataFrame([(1, "beta delta delta")], "question_id bigint, question string")
    got = {r.chunk_id: r.score for r in bm25.search(index, bm25.term_stats(index), questions).collect()}
    docs = [t.split() for t in texts]
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    avg = sum(map(len, docs)) / 4
    want = {}
    for i, d in enumerate(docs):
        s = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in ("beta", "delta", "delta"))
        if s > 0:
            want[str(i)] = round(s, 6)
    assert got == pytest.approx(want)


def test_fusion_bound(spark):
    lists = {n: spark.createDataFrame([(1, "c", 1, 0.9)], "question_id bigint, chunk_id string, rank int, score double") for n in ("dense", "bm25", "structural")}
    assert R.fuse(lists, 8).first().rrf == pytest.approx(3 / 61)


def test_hints_from_the_question(spark):
    rows = [(1, "제 15 조의 2 제3항과 15조, 별표 2 학생인건비 지급 기준은 p151 및 12쪽"), (2, None)]
    got = {r.question_id: r for r in Q.parse_questions(spark.createDataFrame(rows, "question_id bigint, question string")).collect()}
    assert got[1].article_nos == ["제15조의2", "제15조"] and got[1].paragraphs == ["제3항"] and got[1].appendices == ["별표2"]
    assert got[1].target_pages == [151, 12] and "학생인건비" in got[1].keywords and "지급" in got[1].keywords
    assert got[2].keywords == [] and got[2].kind == "open"


MODEL = (
    "question_id bigint, kind string, chat_response string, target_pages array<int>, target_articles array<string>, target_paragraphs array<string>, "
    "target_items array<string>, target_appendices array<string>, target_forms array<string>, target_sections array<string>, topic_keywords array<string>, "
    "comparison_intent boolean, doc_name_hint string, rewritten_query string"
)


def test_model_hints_come_first_and_rules_apply(spark):
    questions = spark.createDataFrame([(i, "별표 2 학생인건비 지급 기준 151쪽" if i == 1 else "학생인건비") for i in (1, 2, 3)], "question_id bigint, question string")
    none = []
    model = [
        (1, "article_lookup", "", [0, 7], none, none, none, ["별표2", " 별표3 "], none, none, none, False, "", ""),
        (2, "chat", "", none, none, none, none, none, none, none, ["x"], True, "매뉴얼", "다시"),
    ]
    got = {r.question_id: r for r in H.merge_hints(Q.parse_questions(questions), spark.createDataFrame(model, MODEL)).collect()}
    assert got[1].appendices == ["별표2", "별표3"] and got[1].target_pages == [7, 151] and got[1].kind == "page_lookup"
    assert got[1].rewritten_query == "별표 2 학생인건비 지급 기준 151쪽"
    assert got[2].keywords == [] and got[2].chat_response == H.CHAT_DEFAULT and got[2].rewritten_query == ""
    assert got[3].kind == "open" and got[3].keywords == ["학생인건비"]


def test_vectors_of_other_lengths_stop_the_search(spark):
    """Numbers of one row must not be scored as another's."""
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "question_id bigint, embedding array<double>")
    for rows in ([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], [("a", [1.0, 0.0])], [("a", [1.0, 0.0, 0.0, 0.0]), ("b", None)]):
        with pytest.raises(Exception, match="find them with validate"):
            dense.top_k(asked, spark.createDataFrame(rows, "chunk_id string, embedding array<double>").coalesce(1), 5).collect()


def test_a_common_set_meets_in_many_partitions(spark, monkeypatch):
    """A phrase that half of the chunks hold is scored in many tasks."""
    monkeypatch.setattr(dense, "ITEM_BLOCK", 10)
    items = spark.range(400).select(F.col("id").cast("string").alias("chunk_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    members = items.filter("chunk_id % 2 = 0").select(F.lit("common").alias("phrase"), "chunk_id")
    asked = spark.createDataFrame([("common", "1", [1.0, 0.0])], "phrase string, asked string, embedding array<double>")
    seen = []
    real = dense._best
    monkeypatch.setattr(dense, "_best", lambda met, k: seen.append(met) or real(met, k))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dense.top_k_within(asked, members, items, ["phrase"], 3).collect()
        held = seen[0].groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 3 and held >= 4


def test_the_rewritten_question_is_searched(spark):
    """A follow-up question finds what its rewritten text names, not what its own words do."""
    chunks = spark.createDataFrame([("a", "alpha alpha", "", ""), ("b", "beta beta", "", ""), ("c", "gamma", "", ""), ("d", "delta", "", "")], "chunk_id string, text string, article_no string, article_title string")
    index = bm25.chunk_terms(chunks)
    rows = [(1, "alpha", " beta "), (2, "alpha", ""), (3, "alpha", None)]
    asked = spark.createDataFrame(rows, "question_id bigint, question string, rewritten_query string").withColumn("searched", H.searched_text())
    got = {r.question_id: r.chunk_id for r in bm25.search(index, bm25.term_stats(index), asked, 1, "searched").collect()}
    assert got == {1: "b", 2: "a", 3: "a"}
    near = dense.top_k(dense.embed_questions(asked, "searched"), dense.embed_chunks(chunks), 1).collect()
    assert {r.question_id: r.chunk_id for r in near} == {1: "b", 2: "a", 3: "a"}


def test_any_pattern_is_survived(spark):
    """Patterns that only one engine knows, broken ones and empty ones give rows or literal matches, and no request ends another's."""
    from docspark.operators import lookup

    pages = spark.createDataFrame([("d", 1, "제1조 a(b [x ax"), ("d", 2, r"\Q 제2조")], "source_file string, page_num int, text string")
    queries = ["(?P<n>제)", "(?a)x", "x{,2}", "[[]x", "a(b", "(", r"\Q", "*", "A", "", None]
    asked = spark.createDataFrame([(i, "d", q) for i, q in enumerate(queries)], "request_id bigint, source_file string, query string")
    got = {(r.request_id, r.page): r.match for r in lookup.search_text(asked, pages).collect()}
    assert got[0, 1] == got[0, 2] == "제" and got[1, 1] == "x" and got[3, 1] == "[x" and got[4, 1] == "a(b" and got[5, 1] == "(" and got[6, 2] == r"\Q" and got[8, 1] == "a"
    labels = spark.createDataFrame([(1, "제1조 a(b"), (2, "*")], "request_id bigint, article_no string").withColumn("source_file", F.lit("d"))
    docs = pages.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("pages"))
    assert lookup.article_span(labels, docs).count() == 2


def test_a_page_is_met_by_its_number(spark):
    from docspark.operators import lookup

    docs = spark.createDataFrame([("a.pdf", [(1, "x"), (2, "y")]), ("b.hwp", [(1, "z")]), ("c.pdf", [])], "source_file string, pages array<struct<page_num:int,text:string>>")
    asked = [(1, "a.pdf", "2"), (2, "a.pdf", "3"), (3, "a.pdf", "q"), (4, "b.hwp", "9"), (5, "c.pdf", "1"), (6, "no", "1"), (7, "a.pdf", "2")]
    rows = lookup.read_page(spark.createDataFrame(asked, "request_id bigint, source_file string, page_num string"), docs)
    got = {r.request_id: (r.text, r.error) for r in rows.collect()}
    assert got == {1: ("y", None), 7: ("y", None), 2: ("", "out_of_range"), 3: ("", "not_integer"), 4: ("z", None), 5: ("", "empty"), 6: ("", "not_found")}


def test_names_in_decomposed_form_have_a_category(spark):
    import unicodedata

    chunks = spark.createDataFrame([("a", unicodedata.normalize("NFD", "혁신법 시행령")), ("b", "매뉴얼")], "chunk_id string, doc_name string")
    nearest = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2)], "question_id bigint, chunk_id string, score double, rank int")
    assert {r.category for r in R.category_top1(nearest, chunks).collect()} == {"시행령", "매뉴얼"}


def test_blocks_are_passed_by(monkeypatch):
    """Bounds skip blocks without changing a row; the blocks with a rare term's chunks are scored."""
    rng = random.Random(8)
    terms = [f"t{i}" for i in range(60)]

    def batch(block):
        held = [rng.sample(terms[:50], 6) + (["rare"] if block == 2 and i == 3 else []) for i in range(40)]
        gains = [[rng.random() for _ in h] for h in held]
        asked = [(f"q{i % 7}", t, rng.uniform(-0.2, 3)) for i, t in enumerate(terms[:40])] + [("q1", "rare", 9.0), ("q9", "rare", 5.0), ("q9", terms[0], 0.01)]
        rows = {
            "block": pa.array([0], pa.int32()), "ids": pa.array([[f"c{block:03d}-{i:02d}" for i in range(40)]]), "sizes": pa.array([[len(h) for h in held]], pa.list_(pa.int32())),
            "terms": pa.array([[t for h in held for t in h]]), "gains": pa.array([[g for gs in gains for g in gs]]), "asked": pa.array([[a[0] for a in asked]]),
            "term": pa.array([[a[1] for a in asked]]), "weight": pa.array([[a[2] for a in asked]]),
        }
        return pa.RecordBatch.from_pydict(rows)

    rng_state = rng.getstate()
    out, counted = {}, {}
    for prune in (True, False):
        rng.setstate(rng_state)
        first = [batch(b) for b in range(30)]
        fixed = first[0]
        same = [pa.RecordBatch.from_pydict({c: (fixed if c in ("asked", "term", "weight") else b).column(c) for c in b.schema.names}) for b in first]
        counted[prune] = {}
        got = pa.Table.from_batches(list(bm25._scored(1, prune, counted[prune])(iter(same)))).to_pylist()
        out[prune] = sorted((r["asked"], r["chunk_id"], r["score"]) for r in got)
    assert out[True] == out[False] and len(out[True]) == 8
    assert dict((q, c) for q, c, _ in out[True])["q9"] == "c002-03"
    assert counted[True]["skipped"] > counted[False].get("skipped", 0) + 20


def test_required_strings():
    from docspark.operators import lookup

    for query, needed in ((r"제\d+조의\d", "조의"), ("연구활동비를 사", "연구활동비를 사"), ("별표 1(", "별표 1("), (r"(가나|다라)", ""), (r"(마바사)+아?", "마바사"), ("abc", ""), ("a1-2b", "1-2"),
                          (r"(?x) 가 나", ""), (r"가{0,3}나다*", "나"), (r"[가-하]", ""), ("(?:가(?:나다))라", "가나다라"), ("", "")):
        assert lookup.required(query) == needed, query
    rng = random.Random(1)
    for _ in range(300):
        query = "".join(rng.choice(["가", "나", "1", "a", ".", "[가나]", "(가1)", "가?", "나+", "(?:1|가)", "\\d", "B"]) for _ in range(5))
        text = "".join(rng.choice("가나1aAbB ") for _ in range(12))
        if lookup.compiled(query).search(text):
            assert lookup.required(query) in text, (query, text)


def test_a_pattern_that_does_not_end(spark):
    """Nested repeats stop at the limit and are reported; other pages and patterns are found."""
    from docspark.operators import lookup

    pages = spark.createDataFrame([("f", 1, "a" * 60 + "!"), ("f", 2, "가나 aaa"), ("f", 3, "다")], "source_file string, page_num long, text string")
    asked = spark.createDataFrame([(1, "f", "(a|aa)+$"), (2, "f", "가나")], "request_id long, source_file string, query string")
    assert {(r.request_id, r.page) for r in lookup.search_text(asked, pages, limit_s=0.3).collect()} == {(1, 2), (2, 2)}
    stopped = {(r.request_id, r.page) for r in lookup.stopped_searches(asked, pages, limit_s=0.3).collect()}
    assert stopped == {(1, 1)}


def test_segments_give_the_same_spans(spark):
    """Requests served from the segment table get what a look at their whole document gives."""
    from docspark.operators import lookup

    rng = random.Random(6)
    rows = []
    for d in range(6):
        pages = ["\n".join(rng.choice(["제3조(목적)", "제3조의2(범위)", "별표 1", "부칙", "본문 " * 60, "짧다", "제3조 참조"]) for _ in range(6)) for _ in range(3)]
        rows.append((f"f{d}.pdf", [(i + 1, t) for i, t in enumerate(pages)]))
    docs = spark.createDataFrame(rows, "source_file string, pages array<struct<page_num:int,text:string>>")
    labels = ["제3조", "제 3조", "제3조의2", "별표 1", "부칙", "본문", "제9조", "없는 말", "짧다", None]
    asked = spark.createDataFrame([(d * 100 + i, f"f{d}.pdf", label) for d in range(7) for i, label in enumerate(labels)], "request_id long, source_file string, article_no string")
    got = {tuple(r) for r in lookup.article_span(asked, docs).collect()}
    assert got == {tuple(r) for r in lookup._span_in_text(asked, docs).collect()} and len(got) == 60
    assert {r[6] for r in got} == {"header", "fallback", "none"}


def test_words_are_read_once(spark):
    """The word index reads its texts in one batch function, not in split expressions; null texts have no words."""
    rows = [("a", "가나 Ab가나 ab, ab 3-4"), ("b", ""), ("c", None), ("d", "!?"), ("e", "다라\n가나")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").localCheckpoint()
    got = matching.word_index(chunks)
    plain = chunks.select("chunk_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and plan.count("ArrowEvalPython") == 1


def test_unasked_terms_stay_behind(spark):
    """A packed index holds the asked terms only, with the gains they had, and searches alike whether they are sent along or not."""
    rows = [("a", 4, [("x", 2), ("y", 2)]), ("b", 2, [("z", 2)]), ("c", 0, []), ("d", 6, [("w", 1), ("x", 5)])]
    index = spark.createDataFrame(rows, "chunk_id string, doc_len int, terms array<struct<term:string,tf:int>>")
    schema = "ids array<string>, sizes array<int>, terms array<string>, gains array<double>"

    def packed(known):
        rows = index.coalesce(1).mapInArrow(bm25._pack_index(known, 3.0), schema).collect()
        return [(i, n, t, g) for r in rows for i, n, t, g in [(list(r.ids), list(r.sizes), list(r.terms), list(r.gains))]]

    gain = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 3.0))
    ((ids, sizes, terms, gains),) = packed(spark.sparkContext.broadcast(pa.array(["x", "q"])))
    assert (ids, sizes, terms) == (["a", "d"], [1, 1], ["x", "x"]) and gains == pytest.approx([gain(2, 4), gain(5, 6)])
    ((ids, sizes, terms, gains),) = packed(None)
    assert (ids, sizes, terms) == (["a", "b", "d"], [2, 1, 2], ["x", "y", "z", "w", "x"])


def test_a_latin_word_asks_no_pattern(monkeypatch):
    """Words of ASCII letters and digits are only put in lower case; Korean ones lose one particle."""
    monkeypatch.setattr(T.re, "search", lambda *_: pytest.fail("searched"))
    assert [T.normal(w) for w in ("AbC9", "연구에서는", "연구활동비를", "활동을", "A연구에서")] == ["abc9", "연구", "연구활동비", "활동을", "A연구"]
