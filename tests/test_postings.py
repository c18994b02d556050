"""Postings with the counts of their terms."""

import pytest
from pyspark.sql import functions as F

from docspark.operators import bm25


def made(spark):
    rows = [(f"c{i}", 3, [("all", 1), (f"t{i % 5}", 2), (f"only{i}", i)]) for i in range(40)]
    index = spark.createDataFrame(rows, "chunk_id string, doc_len int, terms array<struct<term:string,tf:int>>")
    return index, bm25.term_stats(index)


@pytest.mark.parametrize("limit", [1 << 20, 6 * bm25.ROW_BYTES + 80, bm25.ROW_BYTES, 0])
def test_frequent_terms_are_sent(spark, monkeypatch, limit):
    """All terms, the six or the one most frequent, or none are sent to the chunks: the rows are those of one join, and what is sent shuffles no posting."""
    index, terms = made(spark)
    monkeypatch.setattr(bm25, "BROADCAST_BYTES", limit)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = bm25.postings(index, terms)
        plan = got._jdf.queryExecution().executedPlan().toString()
        shuffled = plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin")
        assert shuffled == (0 if limit == 1 << 20 else 1)
        flat = index.select("chunk_id", "doc_len", F.inline("terms")).join(terms, "term")
        want = flat.select("chunk_id", F.col("doc_len").cast("bigint"), "term", F.col("tf").cast("bigint"), "df", "idf")
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() == 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
