"""Logged model responses to typed answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docspark import profiles as P
from docspark import schemas

FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first brace-balanced object in each text, strings and escapes respected; null when there is none."""
    decoder = json.JSONDecoder(strict=False)

    def balanced(text: str | None) -> str | None:
        begin = (text or "").find("{")
        if begin < 0:
            return None
        try:
            _, stop = decoder.raw_decode(text, begin)
            return text[begin:stop]
        except ValueError:
            return _outer_braces(text[begin:])

    return texts.map(balanced)


def _outer_braces(text: str) -> str | None:
    """Balanced braces of text that is no valid JSON: quoted stretches are masked before counting."""
    level, quoted, skip = 0, False, False
    for at, char in enumerate(text):
        if skip:
            skip = False
        elif quoted and char == "\\":
            skip = True
        elif char == '"':
            quoted = not quoted
        elif not quoted and char in "{}":
            level += 1 if char == "{" else -1
            if level == 0:
                return text[: at + 1]
    return None


def parse_answers(responses: DataFrame, first_chunks: DataFrame) -> DataFrame:
    """question_id, answer and error; rejected responses are kept with the reason.

    ``responses``: question_id, response. ``first_chunks``: question_id, doc_name, article_no, page, text of the best
    evidence, which stands in for an answer's missing citations with a quote of 50 characters.
    """
    fenced = F.regexp_extract("response", FENCED, 1)
    rows = responses.withColumn("object", F.when(fenced != "", fenced).otherwise(first_object(F.col("response"))))
    schema = schemas.ANSWER + ", _corrupt string"
    rows = rows.withColumn("a", F.from_json("object", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    rows = rows.join(first_chunks, "question_id", "left")
    stand_in = F.array(F.struct(
        F.col("doc_name").alias("document_name"), F.col("article_no"), F.col("page").cast("int").alias("page"), F.left("text", F.lit(50)).alias("quote")
    ))
    cited = F.when(F.coalesce(F.size("a.citations"), F.lit(0)) > 0, F.col("a.citations")).when(F.col("doc_name").isNotNull(), stand_in)
    missing = F.col("a.summary").isNull() | F.col("a.follow_up_needed").isNull() | F.col("a.follow_up_questions").isNull() | F.col("a.risk_notes").isNull()
    error = (
        F.when(F.trim("response") == "", "empty").when(F.col("object").isNull(), "no_object")
        .when(F.col("a").isNull() | F.col("a._corrupt").isNotNull(), "bad_json")
        .when(~F.coalesce(F.col("a.verdict").isin(*P.VERDICTS), F.lit(False)), "bad_verdict").when(missing, "missing_field")
        .when(F.coalesce(F.size(cited), F.lit(0)) < 1, "no_citation")
    )
    return rows.select(
        "question_id", error.alias("error"), "a.verdict", "a.summary", cited.alias("citations"), "a.follow_up_needed", "a.follow_up_questions", "a.risk_notes"
    )
