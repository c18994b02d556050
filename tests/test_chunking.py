"""Chunking rules on small literal documents."""

import pytest
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions import text as X
from docspark.operators import chunking as C

SCHEMA = "source_file string, doc_name string, doc_type string, pages array<struct<page_num:int,text:string>>"


def chunks(spark, source_file, doc_type, *pages):
    rows = [(source_file, "이름", doc_type, [(i + 1, t) for i, t in enumerate(pages)])]
    return C.chunk_documents(spark.createDataFrame(rows, SCHEMA)).collect()


def segments(spark, text, doc_type="시행령", source_file="a.pdf"):
    rows = [(source_file, "이름", doc_type, [(1, text)])]
    return C.split_segments(spark.createDataFrame(rows, SCHEMA)).orderBy("seg_no").collect()


BODY = " 이 조문은 연구개발비의 사용에 관한 세부 사항을 정하는 것을 목적으로 한다."


def test_inline_references_are_no_headers(spark):
    got = segments(spark, "[별표 2] (제20조제1항 관련)\n이 내용은 법 제32조에 따라 정한다." + BODY)
    assert [s.label for s in got] == [""]


def test_two_headers_and_titles(spark):
    got = segments(spark, f"제13조(연구개발비의 사용) {BODY}\n제15조의2(정산)\n{BODY}")
    assert [s.label for s in got] == ["제13조", "제15조의2(정산)"]
    assert got[0].title == "연구개발비의 사용"


@pytest.mark.parametrize("indent,found", [(0, True), (3, True), (4, False)])
def test_indent_limit(spark, indent, found):
    got = segments(spark, "머리말 문장이 여기에 충분히 길게 있다고 하자.\n" + " " * indent + "제7조(목적)" + "\n" + BODY)
    assert ("제7조(목적)" in [s.label for s in got]) == found


def test_preamble_gets_its_own_segment(spark):
    got = segments(spark, "이것은 서문으로서 스무 글자가 넘는 문장입니다.\n부칙\n" + BODY)
    assert [s.label for s in got] == ["서문", "부칙"]


def test_appendix_route_wins_and_labels_parts(spark):
    items = "\n".join(f"{i}. " + "연구개발비 항목 설명 " * 20 for i in range(1, 15))
    got = chunks(spark, "[별표 2] 연구개발비 사용용도(제20조제1항 관련).hwp", "매뉴얼", "■ 시행령 [별표 2]\n연구개발비 사용용도(제20조 관련)\n" + items)
    labels = sorted(c.article_no for c in got)
    assert len(got) > 1 and all(label.startswith("별표 2 (part ") for label in labels)
    assert {c.article_title for c in got} == {"연구개발비 사용용도"}


def test_appendix_markers(spark):
    row = spark.range(1).select(
        F.size(X.split_items(F.lit("머리\n  나) 항목\n"))).alias("plain"),
        F.size(X.split_items(F.lit("머리\n  나) 항목\n"), P.APPENDIX_ITEM_MARKERS)).alias("appendix"),
    ).first()
    assert (row.plain, row.appendix) == (1, 2)


def test_manual_pages(spark):
    text = "제13조(정의)\n[별표 5] 인용이 있어도 쪽 단위로 나눈다는 규칙이다."
    got = chunks(spark, "[본권] 매뉴얼_배포용.pdf", "매뉴얼", text, text, text)
    assert sorted((c.article_no, c.page) for c in got) == [("p.1", 1), ("p.2", 2), ("p.3", 3)]


def test_long_page_parts_stay_on_their_page(spark):
    text = "\n".join(f"{i}. " + "항목 설명 문장입니다. " * 20 for i in range(1, 16))
    got = chunks(spark, "[본권] 매뉴얼.pdf", "매뉴얼", text)
    assert len(got) > 1 and {c.page for c in got} == {1}
    assert all(c.article_no.startswith("p.1 (part ") and len(c.text) <= P.MAX_CHUNK_LEN for c in got)


def test_faq_markers(spark):
    got = segments(spark, "Q1. 회의비는 어디까지 쓸 수 있습니까 알려 주십시오.\n질문 2 그 밖의 비용은 어떻게 됩니까.", "FAQ")
    assert [s.label for s in got] == ["FAQ-1", "FAQ-2"]


def test_packing_keeps_every_character_and_the_limit(spark):
    text = "\n".join("가나다라마바사 " * (i % 400) for i in range(60)) + "x" * 5000
    parts = spark.createDataFrame([(text,)], "t string").select(X.split_lines(F.col("t")).alias("p")).first().p
    assert all(len(p) <= P.MAX_CHUNK_LEN for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_part_page_follows_the_text(spark):
    pages = ["\n".join(f"{i}. " + f"쪽{p} 설명 문장입니다. " * 12 for i in range(1, 12)) for p in range(1, 4)]
    got = sorted(chunks(spark, "a.pdf", "시행령", *pages), key=lambda c: int(c.article_no.split("part ")[1].split("/")[0]))
    assert got[0].page == 1 and got[-1].page == 3
    assert [c.page for c in got] == sorted(c.page for c in got)


def test_anchored_questions(spark):
    """Markers inside a line and small letters do not cut, and the text before the first marker stays."""
    from docspark import profiles as P
    from docspark.operators import chunking

    lead = "이 문서는 자주 묻는 것을 모은 것으로 질문과 답변의 순서로 적혀 있습니다. " * 2
    first = "Q1. 연구비의 용도는 무엇인가요, 그리고 문 앞에서 q 라고 적힌 것은? " + "설명 " * 20
    second = "○ 답변 사용 가능한 비목을 확인합니다. " + "내용 " * 20
    docs = spark.createDataFrame(
        [("자주 묻는 FAQ.pdf", "FAQ", "FAQ", [(1, lead + "\n" + first), (2, second)])],
        "source_file string, doc_name string, doc_type string, pages array<struct<page_num:int,text:string>>",
    )
    loose = [r.seg_text for r in chunking.split_segments(docs).orderBy("seg_no").collect()]
    got = chunking.split_segments(docs, anchored=True).orderBy("seg_no").collect()
    assert [r.seg_text for r in got] == [lead.strip(), first.strip(), second.strip()] and len(loose) > 3
    assert [(r.label, r.page) for r in got] == [(P.PREAMBLE_LABEL, 1), ("FAQ-1", 1), ("FAQ-2", 2)]
    assert chunking.chunk_documents(docs, anchored=True).count() >= 2


def test_segments_are_cut_once(spark):
    """Every document is searched for headers once per route, and a segment is split into parts once."""
    row = [("a.pdf", "혁신법", "시행령", [(1, "제1조(목적)\n" + "가나다라마 " * 30)])]
    docs = spark.createDataFrame(row, "source_file string, doc_name string, doc_type string, pages array<struct<page_num:int,text:string>>").localCheckpoint()
    plan = C.chunk_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count(C.X.item_boundary(C.P.ITEM_MARKERS)) == 1


def test_headers_start_lines(spark):
    """The joined header pattern finds what the single patterns find."""
    text = "\n \n부 칙\n제1조(가) 나\n    제2조(다)\n   제3조 (라\n마)\n■ 별표 4\n별표\n 별표 없음\n가 제5조(사)\n\n\n◎ 별표 6 (아)\n부칙"
    got = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_extract_all("t", F.lit(C.ARTICLE_HEADER), F.lit(0)).alias("new"), F.regexp_extract_all("t", F.lit("(?md)" + "|".join(C.P.ARTICLE_PATTERNS)), F.lit(0)).alias("old")).first()
    assert got.new == got.old and len(got.new) > 4


def test_offsets_do_not_read_the_text_for_every_cut(spark):
    """The start of each cut, with a text before the first one; no lambda holds the length of the whole text."""
    text = "머리말\n" + "".join(f"제{n}조(목적)\n" + "가나 " * n + "\n" for n in range(1, 60))
    docs = spark.createDataFrame([(text, "articles")], "full_text string, route string").localCheckpoint()
    cut = C._with_cuts(docs)
    got = cut.select("cut_starts", "cuts").first()
    assert [text[a:].startswith(c.head) for a, c in zip(got.cut_starts, got.cuts)] == [True] * 59 and got.cut_starts[-1] == len(text)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert not [part for part in plan.split("lambdafunction(")[1:] if "length(full_text" in part.split(", lambda ")[0]]
