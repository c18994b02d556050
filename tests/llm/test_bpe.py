"""Byte-level BPE against the tokenizers library."""

import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
from helpers import docs
from tokenizers import Tokenizer

from docspark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [chr(c) for c in range(0x20, 0x250)] + list(" \n\t\r'sdtl\u00a0\u3000\x85\x1c\u200b\u2019\u4e2d\U0001f600\u0e33\u093f\u1c89\ua7cf") * 20 + ["<|endoftext|>", "'ll", "  "] * 10


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts(own, library, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    texts += ["", " ", "\n\n", "a" * 30000, "ab" * 20000, "x" + " " * 5000 + "y", "<|endoftext|><|endoftext|>", "<|endoftext", "it's I'LL we'd"]
    for text in texts:
        ids = own.encode(text)
        assert bpe.id_list(ids) == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert own.decode(ids) == text
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "STEP", 3)
    for text in texts[:200]:
        assert bpe.id_list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_few_words_kept(library, monkeypatch):
    """Ids do not depend on what a worker has met before."""
    monkeypatch.setattr(bpe, "KEPT", 5)
    with open(PATH, encoding="utf-8") as f:
        small = bpe.Vocabulary(f.read())
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice(["alpha", "betax", "Gammas", "deltoid", "e", "zeta9", "etas", "theta"]) for _ in range(12))
        assert bpe.id_list(small.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_decode_of_any_ids(own, library):
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids, skip_special_tokens=False)


def test_words_of_every_character(library):
    """Every character is letter, number, blank or other as in the library."""
    patterns = bpe._patterns()
    for c in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 3), *range(0x20000, 0x40000, 101)]:
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}"
        assert [m.span() for m in patterns.of(text).finditer(text)] == [tuple(w[1]) for w in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_rows(spark, own):
    rows = docs(spark)
    out = bpe.decode(bpe.encode(rows, PATH, ["doc_id", "text", "row"]), PATH, ["doc_id", "text", "row", "ids"]).collect()
    assert len(out) == rows.count()
    assert all(r["decoded"] == (r["text"] or "") and r["row"] == "clash" and bytes(r["ids"]) == own.encode(r["text"] or "") for r in out)
    assert bpe.encode(rows.limit(0), PATH, ["doc_id"]).count() == 0


def test_query(spark, library, tmp_path):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_other_files_are_refused(spark, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        made = json.load(f)
    made["model"]["byte_fallback"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    with pytest.raises(ValueError):
        bpe.encode(docs(spark), str(tmp_path / "t.json"), ["doc_id"])
