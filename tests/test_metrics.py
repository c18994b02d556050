"""The metrics of an index: totals and distributions in one report."""

from docspark.operators import quality

SCHEMA = "doc_name string, doc_type string, article_no string, source_file string, text string"


def test_index_metrics_have_all_their_parts(spark):
    """Totals, the 15 largest documents, all types and the appendices without their part; a null text or label counts as an empty one."""
    rows = [(f"d{i:02}", "law", "제1조", "a.pdf", "x" * 4) for i in range(17) for _ in range(i + 1)]
    rows += [("d16", "guide", "별표 6 (part 1/2)", "b.HWP", "y" * 9), ("d16", "guide", "별표 6 (part 2/2)", "b.HWP", "y"), ("d16", "guide", "별표 2", "c.pdf", None), ("d16", "guide", None, "c.pdf", "")]
    got = [tuple(r) for r in quality.index_metrics(spark.createDataFrame(rows, SCHEMA)).collect()]
    n = 17 * 18 // 2 + 4
    total = next(r for r in got if r[0] == "index")
    assert total[1:3] == (None, n) and abs(total[3] - (4 * (n - 4) + 10) / n) < 1e-9 and total[4:6] == (9, 1) and abs(total[6] - 1 / n) < 1e-9 and total[7] == 1
    counts = {(r[0], r[1]): r[2] for r in got if r[0] != "index"}
    named = {("doc_name", f"d{i:02}"): i + 1 for i in range(2, 16)} | {("doc_name", "d16"): 21}
    assert counts == named | {("doc_type", "law"): n - 4, ("doc_type", "guide"): 4, ("appendix", "별표 6"): 2}


def test_metrics_of_an_empty_index(spark):
    assert [tuple(r) for r in quality.index_metrics(spark.createDataFrame([], SCHEMA)).collect()] == [("index", None, 0, 0.0, 0, 0, 0.0, 0)]
