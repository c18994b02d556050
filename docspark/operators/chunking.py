"""Document rows to structural chunks, row by row and without a shuffle.

Input: one row per document with ``pages array<struct<page_num int, text string>>``. Everything up to the chunk rows is an
expression on that row, so the work splits over documents and no document waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions import text as X

# All patterns start at a line; asking for that once spares trying each of them at every character.
ARTICLE_HEADER = "(?md)^(?:" + "|".join(p.removeprefix("^") for p in P.ARTICLE_PATTERNS) + ")"
FAQ_MARKER = "(?i)" + "|".join(P.FAQ_PATTERNS)
FAQ_ANCHORED = "(?md)" + P.FAQ_ANCHORED


def with_full_text(docs: DataFrame) -> DataFrame:
    """Adds ``full_text`` (non-blank pages joined by one newline) and ``boundaries`` (start, page_num)."""
    kept = docs.withColumn("pages", F.filter("pages", lambda p: ~X.is_blank(p["text"])))
    starts = X.running_starts(F.transform("pages", lambda p: F.length(p["text"])), gap=1)
    return kept.withColumn("full_text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n")).withColumn(
        "boundaries",
        F.zip_with(
            "pages", F.slice(starts, F.lit(1), F.size("pages")),
            lambda p, start: F.struct(start.alias("start"), p["page_num"].alias("page_num")),
        ),
    )


def route(source_file: Column, doc_type: Column) -> Column:
    """appendix > manual > faq > articles."""
    manual = doc_type.isin(*P.MANUAL_DOC_TYPES)
    for token in P.MANUAL_NAME_TOKENS:
        manual = manual | F.contains(source_file, F.lit(token))
    return (
        F.when(F.regexp_like(source_file, F.lit(P.APPENDIX_FILE_PATTERN)), "appendix")
        .when(manual, "manual")
        .when(F.upper(doc_type) == "FAQ", "faq")
        .otherwise("articles")
    )


def first_page(boundaries: Column) -> Column:
    return F.coalesce(F.get(boundaries, F.lit(0))["page_num"], F.lit(1))


def segment(text: Column, label: Column, title: Column, page: Column, start: Column, end: Column) -> Column:
    return F.struct(
        text.alias("text"), label.alias("label"), title.alias("title"),
        page.cast("int").alias("page"), start.cast("int").alias("start"), end.cast("int").alias("end"),
    )


def article_title(after_header: Column) -> Column:
    """Bracketed title in the first line after the header, else that line when it is short."""
    first = X.strip(F.get(F.split(X.strip(after_header), P.LINE_BREAKS), F.lit(0)))
    found = F.transform(F.array(first), lambda line: F.struct(line.alias("line"), F.regexp_extract(line, r"\(([^)]{2,30})\)", 1).alias("bracketed")))

    def pick(f: Column) -> Column:
        short = F.when(F.length(f["line"]) <= 30, f["line"]).otherwise("")
        return F.when(f["bracketed"] != "", f["bracketed"]).otherwise(short)

    return F.get(F.transform(found, pick), F.lit(0))


def appendix_title(full_text: Column) -> Column:
    """First of the five first non-blank lines that is not the appendix tag line, cut before a bracket."""
    lines = F.filter(F.transform(F.split(full_text, P.LINE_BREAKS), X.strip), lambda s: s != "")
    plain = F.filter(
        F.slice(lines, 1, 5),
        lambda s: ~F.contains(s, F.lit("[별표")) & ~F.regexp_like(s, F.lit(P.APPENDIX_FILE_PATTERN)),
    )
    titles = F.transform(
        plain,
        lambda s: F.left(
            F.coalesce(F.nullif(X.strip(F.regexp_extract(s, r"^([^()]{2,80})\s*\(", 1)), F.lit("")), s), F.lit(80)
        ),
    )
    return F.coalesce(F.get(titles, F.lit(0)), F.lit(""))


def _cut(full_text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with the text up to the next match: array<struct<head, body>>."""
    heads = F.regexp_extract_all(full_text, F.lit(pattern), F.lit(0))
    bodies = F.slice(F.split(full_text, pattern), F.lit(2), F.lit(1 << 30))  # as many as heads, as no match is empty
    return F.zip_with(
        heads, bodies,
        lambda h, b: F.struct(h.alias("head"), b.alias("body")),
    )


def _with_cuts(docs: DataFrame, anchored: bool = False) -> DataFrame:
    """Adds ``cuts`` and ``cut_starts`` for the documents whose route cuts on markers."""
    cuts = F.when(F.col("route") == "faq", _cut(F.col("full_text"), FAQ_ANCHORED if anchored else FAQ_MARKER))
    none = F.array().cast("array<struct<head:string,body:string>>")
    docs = docs.withColumn("faq_cuts", F.coalesce(cuts, none))
    docs = docs.withColumn(
        "route", F.when((F.col("route") == "faq") & (F.size("faq_cuts") == 0), "articles").otherwise(F.col("route"))
    )
    docs = docs.withColumn(
        "cuts",
        F.when(F.col("route") == "articles", _cut(F.col("full_text"), ARTICLE_HEADER)).otherwise(F.col("faq_cuts")),
    ).drop("faq_cuts")
    # A title may sit in the lines of the segments that follow; every segment has two characters at least, so
    # fifty tops cover the hundred characters looked at.
    docs = docs.withColumn(
        "tops", F.transform("cuts", lambda c: F.left(F.concat(c["head"], c["body"]), F.lit(100)))
    )
    # The text before the first cut is the first length to add up: a lambda that asked for it would read the whole text for every cut.
    lengths = F.transform("cuts", lambda c: F.length(c["head"]) + F.length(c["body"]))
    docs = docs.withColumn("cut_lengths", lengths)
    lead = F.length("full_text") - F.aggregate("cut_lengths", F.lit(0), lambda a, n: a + n)
    starts = X.running_starts(F.concat(F.array(lead), "cut_lengths"))
    return docs.withColumn("cut_starts", F.slice(starts, F.lit(2), F.lit(1 << 30))).drop("cut_lengths")


def article_segments() -> Column:
    """One segment per structural header, the text before the first one as a preamble."""
    full, cuts, starts, bounds = (F.col(c) for c in ("full_text", "cuts", "cut_starts", "boundaries"))
    tops = F.col("tops")

    def one(c: Column, i: Column) -> Column:
        after = F.left(
            F.concat(F.left(c["body"], F.lit(100)), F.array_join(F.slice(tops, i + 2, F.lit(50)), "")), F.lit(100)
        )
        label = X.strip(F.regexp_replace(c["head"], r"^[\s■◎●]+", ""))
        return segment(
            X.strip(F.concat(c["head"], c["body"])), label, article_title(after),
            X.offset_to_page(F.get(starts, i), bounds), F.get(starts, i), F.get(starts, i + 1),
        )

    lead = X.strip(F.left(full, F.get(starts, F.lit(0))))
    preamble = segment(
        lead, F.lit(P.PREAMBLE_LABEL), F.lit(""), first_page(bounds), F.lit(0), F.get(starts, F.lit(0))
    )
    whole = segment(X.strip(full), F.lit(""), F.lit(""), first_page(bounds), F.lit(0), F.length(full))
    body = F.transform(cuts, one)
    return (
        F.when(F.size(cuts) == 0, F.array(whole))
        .when(F.length(lead) >= P.MIN_CHUNK_LEN, F.concat(F.array(preamble), body))
        .otherwise(body)
    )


def faq_segments(anchored: bool = False) -> Column:
    """One segment per question or answer marker; ``anchored`` keeps the text before the first one as a preamble."""
    cuts, starts, bounds = F.col("cuts"), F.col("cut_starts"), F.col("boundaries")
    lead = X.strip(F.left("full_text", F.get(starts, F.lit(0))))
    preamble = segment(lead, F.lit(P.PREAMBLE_LABEL), F.lit(""), first_page(bounds), F.lit(0), F.get(starts, F.lit(0)))
    marked = F.transform(
        cuts,
        lambda c, i: segment(
            X.strip(F.concat(c["head"], c["body"])), F.concat(F.lit("FAQ-"), (i + 1).cast("string")), F.lit(""),
            X.offset_to_page(F.get(starts, i), bounds), F.get(starts, i), F.get(starts, i + 1),
        ),
    )
    return F.when(F.length(lead) >= P.MIN_CHUNK_LEN, F.concat(F.array(preamble), marked)).otherwise(marked) if anchored else marked


def page_segments() -> Column:
    bounds = F.col("boundaries")
    return F.filter(
        F.transform(
            "pages",
            lambda p, i: segment(
                X.strip(p["text"]), F.concat(F.lit("p."), p["page_num"].cast("string")), F.lit(""), p["page_num"],
                F.get(bounds, i)["start"], F.get(bounds, i)["start"] + F.length(p["text"]),
            ),
        ),
        lambda s: F.length(s["text"]) >= P.MIN_CHUNK_LEN,
    )


def appendix_segments() -> Column:
    full = F.col("full_text")
    number = F.regexp_extract("source_file", P.APPENDIX_FILE_PATTERN, 1)
    return F.array(
        segment(
            X.strip(full), F.concat(F.lit("별표 "), number), appendix_title(full), first_page(F.col("boundaries")),
            F.lit(0), F.length(full),
        )
    )


def split_segments(docs: DataFrame, anchored: bool = False) -> DataFrame:
    """One row per segment: the document columns plus route, seg_no, seg_text, label, title, page, start, end.

    ``anchored``: questions and answers are cut only where a marker starts a line, in capitals, and no text before the first one is lost.
    """
    keep = [c for c in docs.columns if c != "pages"]
    rows = _with_cuts(with_full_text(docs).withColumn("route", route(F.col("source_file"), F.col("doc_type"))), anchored)
    segs = (
        F.when(F.col("route") == "appendix", appendix_segments())
        .when(F.col("route") == "manual", page_segments())
        .when(F.col("route") == "faq", faq_segments(anchored))
        .otherwise(article_segments())
    )
    rows = rows.select(*keep, "route", "boundaries", F.posexplode(segs).alias("seg_no", "seg"))
    return rows.select(
        *keep, "route", "boundaries", "seg_no", F.col("seg.text").alias("seg_text"), "seg.label", "seg.title",
        "seg.page", "seg.start", "seg.end",
    )


def split_parts(segments: DataFrame) -> DataFrame:
    """Long segments to parts of at most 2000 characters, with part labels and interpolated pages."""
    text = F.col("seg_text")
    parts = F.when(F.col("route") == "appendix", X.split_long(text, P.APPENDIX_ITEM_MARKERS)).otherwise(
        X.split_long(text, P.ITEM_MARKERS)
    )
    rows = segments.filter(F.length(text) >= P.MIN_CHUNK_LEN).withColumn("parts", F.transform(parts, X.strip))
    rows = rows.withColumn("part_starts", X.running_starts(F.transform("parts", lambda p: F.length(p))))
    keep = [c for c in rows.columns if c not in ("parts", "seg_text")]
    # An inner explode would ask for the size of the parts below, and so cut every segment three times.
    rows = rows.select(*keep, F.size("parts").alias("n_parts"), F.posexplode_outer("parts").alias("part_no", "text")).filter("part_no is not null")
    before = F.get("part_starts", F.col("part_no"))
    total = F.greatest(F.element_at("part_starts", -1), F.lit(1))
    span = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    offset = F.col("start") + F.floor(before / total * span).cast("int")
    many = F.col("n_parts") > 1
    return rows.select(
        *[c for c in keep if c not in ("page", "label", "boundaries", "part_starts")],
        "n_parts", "part_no", "text", F.col("label").alias("parent_label"),
        F.when(
            many,
            F.concat("label", F.lit(" (part "), (F.col("part_no") + 1).cast("string"), F.lit("/"),
                     F.col("n_parts").cast("string"), F.lit(")")),
        ).otherwise(F.col("label")).alias("article_no"),
        F.when(many & (span > 0), X.offset_to_page(offset, F.col("boundaries"))).otherwise(F.col("page")).alias("page"),
    )


def chunk_documents(docs: DataFrame, anchored: bool = False) -> DataFrame:
    """Chunk rows in the canonical schema; ``chunk_id`` is a hash of file, segment and part. ``anchored``: see ``split_segments``."""
    parts = split_parts(split_segments(docs, anchored)).filter(F.length("text") >= P.MIN_CHUNK_LEN)

    def given(name: str, default) -> Column:
        return F.col(name) if name in docs.columns else F.lit(default)

    return parts.select(
        F.sha2(F.concat_ws("#", "source_file", "seg_no", "part_no"), 256).alias("chunk_id"),
        "doc_name", "doc_type", "article_no", F.col("title").alias("article_title"), F.col("page").cast("int"),
        given("effective_date", "").alias("effective_date"), given("revised_date", "").alias("revised_date"),
        given("is_current", True).alias("is_current"), "source_file", "text",
    )
