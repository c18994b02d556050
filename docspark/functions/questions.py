"""Hints read from the question text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions.tokens import words


def _found(question: Column, pattern: str, before: str, after: str = "") -> Column:
    numbers = F.regexp_extract_all(question, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit(before), n, F.lit(after))))


def articles(question: Column) -> Column:
    """제N조 and 제N조의M in canonical spelling, first mention first."""
    whole = F.regexp_extract_all(question, F.lit(r"제?\s*\d+\s*조(?:\s*의\s*\d+)?"), F.lit(0))
    bare = F.transform(whole, lambda m: F.regexp_replace(m, r"[제\s]", ""))
    return F.array_distinct(F.transform(bare, lambda m: F.concat(F.lit("제"), m)))


def paragraphs(question: Column) -> Column:
    return _found(question, r"제?\s*(\d+)\s*항", "제", "항")


def items(question: Column) -> Column:
    return _found(question, r"제?\s*(\d+)\s*호", "제", "호")


def sections(question: Column) -> Column:
    return _found(question, r"제?\s*(\d+)\s*절", "제", "절")


def appendices(question: Column) -> Column:
    return _found(question, r"별표\s*(\d+)", "별표")


def forms(question: Column) -> Column:
    return _found(question, r"별지\s*(\d+)", "별지")


PAGE_MENTION = r"(?i)p\.?\s*\d{1,4}(?![\w가-힣])|\d{1,4}\s*(?:p(?![\w가-힣])|페이지|쪽)"


def pages(question: Column) -> Column:
    """Page numbers named as p151, 151p, 151페이지 or 151쪽, within 1..9999."""
    found = F.regexp_extract_all(question, F.lit(PAGE_MENTION), F.lit(0))
    numbers = F.transform(found, lambda m: F.regexp_extract(m, r"\d+", 0).cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= 9999)))


def strip_keyword_particle(word: Column) -> Column:
    """The first particle of the ordered list that leaves two characters or more is cut off."""
    cut = [
        F.when(F.endswith(word, F.lit(p)) & (F.length(word) - len(p) >= 2), F.left(word, F.length(word) - len(p)))
        for p in P.KEYWORD_PARTICLES
    ]
    return F.coalesce(*cut, word)


def keywords(question: Column) -> Column:
    """Domain words, and Hangul words of four characters or more that are no stopwords."""

    def kept(w: Column) -> Column:
        ordinary = (F.length(w) >= 4) & F.regexp_like(w, F.lit("[가-힣]")) & ~w.isin(*P.STOPWORDS, *P.CORPUS_STOPWORDS)
        return w.isin(*P.DOMAIN_KEYWORDS) | ordinary

    return F.array_distinct(F.filter(F.transform(words(question), strip_keyword_particle), kept))


def doc_type_hints(question: Column) -> Column:
    found = [F.when(F.contains(question, F.lit(surface)), F.lit(kind)) for surface, kind in P.DOC_TYPE_WORDS]
    return F.array_distinct(F.array_compact(F.array(*found)))


def comparison_intent(question: Column) -> Column:
    hit = F.lit(False)
    for word in P.COMPARISON_TRIGGERS:
        hit = hit | F.contains(question, F.lit(word))
    return hit


def parse_questions(questions: DataFrame) -> DataFrame:
    """Adds every hint column to a table with a ``question`` column."""
    text = F.coalesce(F.col("question"), F.lit(""))
    return questions.withColumns(
        {
            "article_nos": articles(text), "paragraphs": paragraphs(text), "items": items(text),
            "appendices": appendices(text), "forms": forms(text), "sections": sections(text),
            "keywords": keywords(text), "doc_type_hints": doc_type_hints(text),
            "comparison_intent": comparison_intent(text), "target_pages": pages(text),
            "doc_name_hint": F.lit(""), "kind": F.lit("open"), "chat_response": F.lit(""), "rewritten_query": text,
        }
    )


def structural_strings() -> Column:
    """Labels to look for: appendix and form hints also in the spaced spelling."""

    def both(hints: str, word: str) -> Column:
        def spell(h: Column) -> Column:
            number = F.trim(F.substring(h, F.lit(len(word) + 1), F.length(h)))
            spaced = F.concat(F.lit(word + " "), number)
            return F.when(F.startswith(h, F.lit(word)) & (number != ""), F.array(h, spaced)).otherwise(F.array(h))

        return F.flatten(F.transform(hints, spell))

    return F.array_distinct(
        F.concat("article_nos", both("appendices", "별표"), both("forms", "별지"), "sections")
    )


def phrase_pairs() -> Column:
    """Every two keywords, in order, joined by a space."""
    return F.flatten(
        F.transform(
            "keywords",
            lambda a, i: F.transform(
                F.slice("keywords", i + 2, F.greatest(F.size("keywords") - i - 1, F.lit(0))),
                lambda b: F.concat_ws(" ", a, b),
            ),
        )
    )
