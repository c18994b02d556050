"""Documents with every odd case, and plain Python versions of the rules."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = [f"w{i}" for i in range(120)]


def sentence(a, b, **changed):
    words = BASE[a:b]
    for at, word in changed.items():
        words[int(at[1:])] = word
    return " ".join(words)


def odd_rows():
    text = sentence(0, 60)
    return [
        (1, text, "en", "a", len(text)), (2, text, "en", None, None), (2, text, "en", None, None),  # copies, a repeated row
        (3, sentence(0, 60, p30="x"), None, "b", 3), (4, "  \t\n ", "en", "a", 5), (5, "", "fr", "b", 0), (6, None, "fr", "a", None),
        (7, "one", "en", "b", 3), (8, "one two", "en", "c", 7), (9, text + "\n" + sentence(40, 120), "en", "c", 9),
        (10, sentence(40, 120) + "\n\nÉté ÇA", "fr", "c", 10), (None, sentence(5, 70), "en", "a", 1), (None, None, None, None, None),
        (12, " ".join(BASE * 40), "de", "d", 12), (13, "12 34 -- !!", "en", "d", 13), (14, sentence(0, 59), "es", "a", 1),
        (15, "ONE", "en", "b", 3), (16, "a\x0bb\x0cc\rd e", "en", "a", 9), (2, sentence(60, 119), "en", "e", 4),
    ]


def docs(spark, rows=None):
    """The rows with further columns whose names operators use themselves."""
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    for name in ("id", "mark", "n", "pos", "s", "start", "range", "key", "name", "size", "shard", "words", "row", "score", "first", "block", "component_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
