"""Hashing of touched files without a listing of all files."""

import hashlib
import unicodedata

from docspark.sources import files


def test_the_roots_are_not_listed(spark, tmp_path):
    """Rows as a listing of Spark's gives them: nothing hidden, no folder, no path outside the roots, names in NFC; and no scan of the roots in the plan."""
    root, other = tmp_path / "a", tmp_path / "b"
    held = {"x/p.pdf": b"1", "x/_q.pdf": b"2", "x/.r.pdf": b"3", "_y/s.pdf": b"4", "_y=1/t.pdf": b"5", "가/나.pdf": b"6", "K.pdf": b"7", "x y/%20#.pdf": b"8", "x/._/u.pdf": b"9"}
    for name, content in held.items():
        path = root / unicodedata.normalize("NFD", name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    for name, content in (("K2.pdf", b"kelvin"), ("p.pdf", b"p")):
        other.mkdir(exist_ok=True)
        (other / name).write_bytes(content)
    (tmp_path / "c.pdf").write_bytes(b"outside")
    asked = [f"{root}/{n}" for n in held] + [f"{root}/x", f"{root}//x/p.pdf", f"{root}/../c.pdf", f"{tmp_path}/c.pdf", f"{root}/gone.pdf", f"{other}/K2.pdf", f"{other}/p.pdf", f"{other}/p.pdf", None]
    touched = spark.createDataFrame([(p,) for p in asked], "path string")
    got = files.hash_files(spark, [str(root), f"file:{other}"], touched)
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    want = {f"{root}/{n}": held[n] for n in ("x/p.pdf", "_y=1/t.pdf", "가/나.pdf", "K.pdf", "x y/%20#.pdf")} | {f"{other}/K2.pdf": b"kelvin", f"{other}/p.pdf": b"p"}
    rows = got.collect()
    assert len(rows) == len(want)
    assert {r.path: (r.size_bytes, r.sha256) for r in rows} == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in want.items()}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([str(root), str(other)]).select("path").collect()
    assert {unicodedata.normalize("NFC", r.path.removeprefix("file:")) for r in listed} == set(want)
