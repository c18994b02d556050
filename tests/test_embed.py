"""The default model over whole batches, and what is kept of a chunk's words."""

import numpy as np
import pandas as pd
import pytest

from docspark.operators import dense, matching


def test_counts_of_a_batch_are_those_of_its_rows():
    rng = np.random.default_rng(1)
    rows = pd.Series([rng.integers(0, dense.DIM, n).astype(np.int32) for n in (0, 5, 900, 0, 1, 64)])
    got = dense.hashed_counts(rows)
    assert got.dtype == np.float32 and got.shape == (6, dense.DIM)
    assert (got == [np.bincount(r, minlength=dense.DIM) for r in rows]).all()
    assert dense.hashed_counts(rows.iloc[:0]).shape == (0, dense.DIM) and not dense.hashed_counts(rows.iloc[:1]).any()
    for bad in ([dense.DIM], [-1]):
        with pytest.raises(ValueError):
            dense.hashed_counts(pd.Series([np.array(bad, np.int32)]))


def test_words_are_kept_by_chunk(spark):
    """A kept chunk has one row with its words; listed, they are the word index, without rows of null or wordless texts."""
    chunks = spark.createDataFrame([("a", "one two one"), ("b", None), ("c", " . "), ("d", "two")], "chunk_id string, text string")
    kept = matching.chunk_words(chunks)
    assert kept.count() == 4 and {tuple(r) for r in matching.listed(kept).collect()} == {("a", "one"), ("a", "two"), ("d", "two")}


def test_proposed_chunks_read_the_index_once(spark):
    """The word index is scanned once for the chunks that it proposes, whether a text has to be looked up or not."""
    chunks = spark.createDataFrame([(f"c{i}", f"alpha w{i} beta{i % 3}") for i in range(30)], "chunk_id string, text string")
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    index = matching.word_index(chunks).mapInArrow(seen, "chunk_id string, word string")
    known = matching.vocabulary(matching.word_index(chunks))
    phrases = spark.createDataFrame([("w7",), ("alpha w8",), ("beta1 alpha",)], "phrase string")
    got = {tuple(r) for r in matching.phrase_matches(chunks, index, phrases, known).collect()}
    assert got == {("w7", "c7"), ("alpha w8", "c8")} | {("beta1 alpha", f"c{i}") for i in range(1, 30, 3)}
    assert reads.value == 90
