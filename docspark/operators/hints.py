"""Hints from a model merged with the hints read from the question text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions.text import strip

# --- fixed value: answer to small talk that came without one ------------------------------------------------
CHAT_DEFAULT = "안녕하세요! 😊 국가연구개발혁신법 매뉴얼·시행령·시행규칙 관련 질문이 있으면 편하게 물어봐 주세요."

PAIRS = {
    "article_nos": "target_articles", "paragraphs": "target_paragraphs", "items": "target_items",
    "appendices": "target_appendices", "forms": "target_forms", "sections": "target_sections",
    "keywords": "topic_keywords",
}


def union(first: Column, second: Column) -> Column:
    """Trimmed non-empty strings of both lists, first list first, without repeats."""
    both = F.concat(F.coalesce(first, F.array().cast("array<string>")), second)
    return F.array_distinct(F.filter(F.transform(both, strip), lambda s: F.length(s) > 0))


def searched_text() -> Column:
    """What is embedded and searched: the rewritten question, which stands without earlier turns, else the question itself."""
    rewritten = strip(F.coalesce("rewritten_query", F.lit("")))
    return F.when(rewritten == "", F.col("question")).otherwise(rewritten)


def merge_hints(parsed: DataFrame, model: DataFrame) -> DataFrame:
    """``parsed`` rows with the model's hints taken in; questions without a model row stay as they are."""
    m = model.select("question_id", F.struct(*[c for c in model.columns if c != "question_id"]).alias("m"))
    rows = parsed.join(m, "question_id", "left")
    has = F.col("m").isNotNull()
    given = strip(F.coalesce(F.col("m.kind"), F.lit("open")))
    in_range = F.filter(
        F.coalesce("m.target_pages", F.array().cast("array<int>")), lambda n: (n >= 1) & (n <= 9999)
    )
    rows = rows.withColumn("pages_all", F.array_distinct(F.concat(in_range, "target_pages")))
    rows = rows.withColumn("kind_given", F.when(given.isin(*P.QUESTION_KINDS), given).otherwise("open"))
    chat = F.col("kind_given") == "chat"
    kind = F.when((F.size("pages_all") > 0) & ~chat, "page_lookup").otherwise(F.col("kind_given"))
    answer = strip(F.coalesce("m.chat_response", F.lit("")))
    rewritten = strip(F.coalesce("m.rewritten_query", F.lit("")))
    none = F.array().cast("array<string>")
    merged = {name: F.when(chat, none).otherwise(union(F.col("m." + other), F.col(name))) for name, other in PAIRS.items()}
    merged |= {
        "doc_type_hints": F.when(chat, none).otherwise(F.col("doc_type_hints")),
        "comparison_intent": ~chat & (F.coalesce("m.comparison_intent", F.lit(False)) | F.col("comparison_intent")),
        "target_pages": F.when(chat, F.array().cast("array<int>")).otherwise(F.col("pages_all")),
        "doc_name_hint": F.when(chat, "").otherwise(strip(F.coalesce("m.doc_name_hint", F.lit("")))),
        "kind": kind,
        "chat_response": F.when(chat, F.coalesce(F.nullif(answer, F.lit("")), F.lit(CHAT_DEFAULT))).otherwise(""),
        "rewritten_query": F.when(chat, "").when(rewritten == "", F.col("question")).otherwise(rewritten),
    }
    return rows.withColumns({k: F.when(has, v).otherwise(F.col(k)) for k, v in merged.items()}).drop(
        "m", "pages_all", "kind_given"
    )
