"""Document, page, article and text lookups for tables of requests."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from functools import lru_cache
from re import _constants, _parser

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from docspark import profiles as P
from docspark.functions import text as X
from docspark.operators.matching import containing_all, contains_join
from docspark.session import settle

SEARCH_SECONDS = 1.0
HEADER = "(?md)" + "|".join(P.LOOKUP_HEADER)


@lru_cache(maxsize=4096)
def compiled(query: str) -> regex.Pattern:
    """The query as a case-blind pattern, or as a literal where it is none; run by an engine that can be stopped."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            re.compile(query, re.IGNORECASE | re.MULTILINE)
            return regex.compile(query, regex.IGNORECASE | regex.MULTILINE)
        except (re.error, regex.error, OverflowError, RecursionError):
            return regex.compile(re.escape(query), regex.IGNORECASE)


def _runs(parts) -> list[str]:
    """Strings that every match of a parsed pattern holds: runs of characters without case that stand side by side and cannot be left out."""
    runs, run = [], ""
    for kind, value in parts:
        if kind is _constants.LITERAL and chr(value).lower() == chr(value).upper() == chr(value).casefold():
            run += chr(value)
            continue
        runs, run = runs + [run], ""
        if kind is _constants.SUBPATTERN:
            runs += _runs(value[3])
        elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            runs += _runs(value[2])
    return runs + [run]


@lru_cache(maxsize=4096)
def required(query: str) -> str:
    """The longest string without case that every match of the query holds, from its parse tree; empty if there is none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            if re.compile(query, re.IGNORECASE | re.MULTILINE).flags & re.VERBOSE:
                return ""
            parts = _parser.parse(query, re.IGNORECASE | re.MULTILINE)
        except (re.error, OverflowError, RecursionError):
            parts = _parser.parse(re.escape(query), re.IGNORECASE)
    return max(_runs(parts), key=len)


@F.pandas_udf(StringType())
def required_text(queries: pd.Series) -> pd.Series:
    return queries.map(lambda q: required(q) if q is not None else "")


def first_match(limit_s: float) -> Callable[..., Column]:
    """First match of each query in its text, its place from 1, and whether the search was stopped after ``limit_s`` seconds."""

    @F.pandas_udf(StructType([StructField("match", StringType()), StructField("at", IntegerType()), StructField("stopped", BooleanType())]))
    def run(queries: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for query, text in zip(queries, texts):
            try:
                found = compiled(query).search(text, timeout=limit_s) if text is not None else None
                rows.append((found.group(), found.start() + 1, False) if found else (None, 0, False))
            except TimeoutError:
                rows.append((None, 0, True))
        return pd.DataFrame(rows, columns=["match", "at", "stopped"])

    return run


def quoted(label: Column) -> Column:
    """The label as a pattern: as it is when it has letters, digits and plain marks only, else as a literal."""
    plain = F.regexp_like(label, F.lit(r"^[\p{L}\p{N}\s.,:_-]*$"))
    literal = F.concat(F.lit(r"\Q"), F.replace(label, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(plain, label).otherwise(literal)


def list_documents(docs: DataFrame) -> DataFrame:
    """Name, type and page count per document; types without pages count one."""
    hwp = F.regexp_like(F.lower("source_file"), F.lit(r"\.hwpx?$"))
    return docs.select(
        F.col("source_file").alias("name"), F.when(hwp, "hwp").otherwise("pdf").alias("type"),
        F.when(hwp, 1).otherwise(F.size("pages")).cast("bigint").alias("pages"),
    )


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def resolve_doc_name(requests: DataFrame, docs: DataFrame, nfc) -> DataFrame:
    """Requested ``doc_name`` to ``name`` of a document, with the tier that matched.

    1 same name, 2 same stem, 3 part of a stem (the shortest wins), 4 every word of two characters or more in the
    name. Each tier works on the distinct names the tiers before it left open.
    """
    asked = requests.select("doc_name").distinct().withColumn("full", F.lower(nfc(X.strip(F.col("doc_name"))))).filter("full <> ''")
    asked = asked.withColumn("stem", _stem(F.col("full")))
    have = docs.select("name").distinct().withColumn("lname", F.lower(nfc(X.strip(F.col("name")))))
    asked, have = settle(asked), settle(have.withColumn("lstem", _stem(F.col("lname"))))

    def tier(rows: DataFrame, no: int) -> DataFrame:
        order = F.struct(F.length("lstem") if no == 3 else F.lit(0), "name")
        return rows.groupBy("doc_name").agg(F.min_by("name", order).alias("name")).withColumn("tier", F.lit(no).cast("bigint"))

    done = settle(tier(asked.join(have, F.col("full") == F.col("lname")), 1))
    left = asked.join(done, "doc_name", "left_anti")
    found = settle(tier(left.join(have, F.col("stem") == F.col("lstem")), 2))
    done, left = done.unionByName(found), settle(left.join(found, "doc_name", "left_anti"))
    inside = contains_join(have.select(F.col("lstem").alias("hay")), left.select(F.col("stem").alias("needle")))
    best = inside.groupBy("needle").agg(F.min_by("hay", F.struct(F.length("hay"), "hay")).alias("lstem"))
    named = have.groupBy("lstem").agg(F.min("name").alias("name"))
    third = left.drop("lstem").join(best, F.col("stem") == F.col("needle")).join(named, "lstem").select(
        "doc_name", "name", F.lit(3).cast("bigint").alias("tier")
    )
    third = settle(third)
    done, left = done.unionByName(third), settle(left.join(third, "doc_name", "left_anti"))
    words = F.filter(F.array_distinct(F.split("full", r"\s+")), lambda w: F.length(w) >= 2)
    wanted = left.select(F.col("doc_name").alias("ask"), words.alias("words"))
    full = containing_all(have.select("lname").distinct(), "lname", "lname", wanted).withColumnRenamed("ask", "doc_name")
    fourth = tier(full.join(have, "lname"), 4)
    return requests.join(done.unionByName(fourth), "doc_name", "left")


def read_page(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Page text or an error per request (request_id, source_file, page_num as text).

    Requests meet the number of pages of their document, then the one page they ask for: no document is copied as a whole.
    """
    rows = requests.join(docs.select("source_file", F.size("pages").alias("n")), "source_file", "left")
    number = F.expr("try_cast(page_num AS int)")
    hwp = F.regexp_like(F.lower("source_file"), F.lit(r"\.hwpx?$"))
    n = F.col("n")
    error = (
        F.when(n.isNull(), "not_found").when(n == 0, "empty").when(hwp, F.lit(None))
        .when(number.isNull(), "not_integer").when((number < 1) | (number > n), "out_of_range")
    )
    rows = rows.withColumn("error", error).withColumn("wanted", F.when(error.isNull(), F.when(hwp, 1).otherwise(number)))
    pages = docs.select("source_file", F.posexplode("pages").alias("pos", "p")).select("source_file", (F.col("pos") + 1).alias("wanted"), F.col("p.text").alias("text"))
    met = rows.join(pages, ["source_file", "wanted"], "left").withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(""))
    page = F.when(hwp & F.col("error").isNull(), 1).otherwise(F.coalesce(number, F.lit(0)))
    return met.select("request_id", "source_file", page.cast("bigint").alias("page"), "text", F.length("text").cast("bigint").alias("char_count"), "error")


def _searched(requests: DataFrame, pages: DataFrame, limit_s: float) -> DataFrame:
    """The requests on every page of their document that holds what their pattern cannot do without, with the outcome ``m``."""
    asked = requests.filter(~X.is_blank(F.coalesce("query", F.lit(""))))
    needed = asked.select("query").distinct().withColumn("needed", required_text("query"))
    rows = asked.join(needed, "query").join(pages, "source_file").filter((F.col("needed") == "") | F.contains("text", F.col("needed")))
    return rows.withColumn("m", first_match(limit_s)("query", "text"))


def search_text(requests: DataFrame, pages: DataFrame, max_results: int = 5, limit_s: float = SEARCH_SECONDS) -> DataFrame:
    """First match per page of a case-blind pattern (request_id, source_file, query), on the first pages that match.

    ``pages``: source_file, page_num, text. A query that is no valid pattern is taken literally. Only pages that hold the string which the pattern requires
    reach the pattern, and a pattern has ``limit_s`` seconds for a page; ``stopped_searches`` tells where that was too little.
    """
    rows = _searched(requests, pages, limit_s).filter("m.match is not null")
    order = W.partitionBy("request_id").orderBy("page_num")
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_results)
    first = first.withColumn("match", F.col("m.match")).withColumn("at", F.col("m.at"))
    low = F.greatest(F.col("at") - P.EXCERPT_MARGIN, F.lit(1))
    high = F.col("at") + F.length("match") + P.EXCERPT_MARGIN
    excerpt = F.translate(F.substring(F.col("text"), low, high - low), "\n", " ")
    return first.select("request_id", "source_file", F.col("page_num").alias("page"), "match", excerpt.alias("excerpt"), F.col("rank").cast("bigint").alias("rank"))


def stopped_searches(requests: DataFrame, pages: DataFrame, limit_s: float = SEARCH_SECONDS) -> DataFrame:
    """request_id, source_file, page of the searches that took longer than the limit, so their page counts as not matched."""
    return _searched(requests, pages, limit_s).filter("m.stopped").select("request_id", "source_file", F.col("page_num").alias("page"))


def list_articles(docs: DataFrame) -> DataFrame:
    """Every structural header per page, in order."""
    rows = docs.select("source_file", F.explode("pages").alias("p"))
    heads = F.regexp_extract_all(F.col("p.text"), F.lit(HEADER), F.lit(0))
    rows = rows.select("source_file", F.col("p.page_num").cast("bigint").alias("page"), F.posexplode(heads).alias("pos", "head"))
    label = X.strip(F.regexp_replace("head", r"^[\s■◎●]+", ""))
    return rows.select("source_file", "page", F.col("pos").cast("bigint").alias("pos"), label.alias("article_no"))


def _with_cuts(docs: DataFrame) -> DataFrame:
    """Adds the whole text, its page boundaries and its header cuts (start, length and normalised label)."""
    rows = docs.withColumn("full", F.array_join(F.transform("pages", lambda p: p["text"]), "\n"))
    rows = rows.withColumn("heads", F.regexp_extract_all("full", F.lit(HEADER), F.lit(0))).withColumn("bodies", F.split("full", HEADER))
    rows = rows.withColumn("page_starts", X.running_starts(F.transform("pages", lambda p: F.length(p["text"])), gap=1))
    rows = rows.withColumn("boundaries", F.zip_with(
        "pages", F.slice("page_starts", F.lit(1), F.size("pages")),
        lambda p, s: F.struct(s.alias("start"), p["page_num"].alias("page_num"))))
    seg_lengths = F.zip_with("heads", F.slice("bodies", F.lit(2), F.size("heads")), lambda h, b: F.length(h) + F.length(b))
    rows = rows.withColumn("ends", X.running_starts(seg_lengths)).withColumn("lead", F.length(F.get("bodies", F.lit(0))))
    return rows.withColumn("cuts", F.zip_with(
        "heads", F.slice("ends", F.lit(1), F.size("heads")),
        lambda h, s: F.struct((s + F.col("lead")).alias("start"), F.length(h).alias("n"), F.regexp_replace(h, r"[\s■◎●]", "").alias("label"))))


def segment_table(docs: DataFrame) -> DataFrame:
    """source_file, norm, body, start_page, end_page: the first segment of every label of every document, up to the next header.

    A document is cut once, whatever is asked of it.
    """
    rows = _with_cuts(docs.select("source_file", "pages")).select("source_file", "full", "boundaries", "cuts", F.posexplode("cuts").alias("no", "cut"))
    nxt = F.get("cuts", F.col("no") + 1)["start"]
    rows = rows.withColumn("start", F.col("cut.start")).withColumn("end", F.coalesce(nxt, F.length("full")))
    body = F.coalesce(X.strip(F.substring(F.col("full"), F.col("start") + 1, F.col("end") - F.col("start"))), F.lit(""))
    pages = [X.offset_to_page(at, F.col("boundaries")).alias(c) for c, at in (("start_page", F.col("start")), ("end_page", F.greatest(F.col("start"), F.col("end") - 1)))]
    cut = rows.select("source_file", F.col("cut.label").alias("norm"), F.col("no"), body.alias("body"), *pages)
    first = F.min_by(F.struct("body", "start_page", "end_page"), "no").alias("s")
    return cut.groupBy("source_file", "norm").agg(first).select("source_file", "norm", "s.*")


def article_span(requests: DataFrame, docs: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Text of a requested label (request_id, source_file, article_no) up to the next header, or whole pages that name it.

    Labels are met in the segment table (by default that of the documents that are asked for). Only requests for other wordings, and those whose segment is missing
    or under 100 characters, look at their document: they get the text at the wording, or the first three of the five first pages that mention it.
    """
    if segments is None:
        segments = segment_table(docs.join(requests.select("source_file").distinct(), "source_file", "left_semi"))
    norm = F.regexp_replace("article_no", r"\s+", "")
    asked = requests.select("request_id", "source_file", "article_no", norm.alias("norm"), F.regexp_like(norm, F.lit(P.LOOKUP_LABEL)).alias("known"))
    long = segments.filter(F.length("body") >= P.ARTICLE_BODY_MIN)
    met = settle(asked.join(long, ["source_file", "norm"], "left").withColumn("direct", F.col("known") & F.col("body").isNotNull()))
    hwp = F.regexp_like(F.lower("source_file"), F.lit(r"\.hwpx?$"))
    page = lambda c: F.when(hwp, F.lit(1)).otherwise(F.col(c)).cast("bigint").alias(c)
    found = met.filter("direct").select("request_id", "source_file", "article_no", F.col("body").alias("text"), page("start_page"), page("end_page"), F.lit("header").alias("matched_via"))
    rest = met.filter("not coalesce(direct, false)").select("request_id", "source_file", "article_no")
    return found.unionByName(_span_in_text(rest, docs))


def _span_in_text(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """The same with the whole document of each request at hand."""
    rows = requests.join(_with_cuts(docs.join(requests.select("source_file").distinct(), "source_file", "left_semi").select("source_file", "pages")), "source_file")
    norm = F.regexp_replace("article_no", r"\s+", "")
    known = F.regexp_like(norm, F.lit(P.LOOKUP_LABEL))
    hit = F.get(F.filter("cuts", lambda c: c["label"] == F.col("norm")), F.lit(0))
    literal = F.instr("full", F.col("article_no"))
    rows = rows.withColumn("norm", norm).withColumn("known", known).withColumn("hit", hit).withColumn("literal", literal)
    start = F.when(F.col("known"), F.col("hit.start")).when(F.col("literal") > 0, F.col("literal") - 1)
    size = F.when(F.col("known"), F.col("hit.n")).otherwise(F.length("article_no"))
    rows = rows.withColumn("start", start).withColumn("after", start + size)
    nxt = F.get(F.filter("cuts", lambda c: c["start"] >= F.col("after")), F.lit(0))["start"]
    rows = rows.withColumn("end", F.coalesce(nxt, F.length("full")))
    rows = rows.withColumn("body", F.coalesce(X.strip(F.substring(F.col("full"), F.col("start") + 1, F.col("end") - F.col("start"))), F.lit("")))
    hwp = F.regexp_like(F.lower("source_file"), F.lit(r"\.hwpx?$"))
    query = F.concat(F.lit("(?im)"), F.when(F.col("known"), F.when(F.startswith("norm", F.lit("제")), F.col("norm")).otherwise(F.col("article_no"))).otherwise(quoted(F.col("article_no"))))
    rows = rows.withColumn("query", query).withColumn(
        "named", F.slice(F.filter("pages", lambda p: F.regexp_like(p["text"], F.col("query"))), 1, P.FALLBACK_PAGES)
    )
    direct = F.length("body") >= P.ARTICLE_BODY_MIN
    blocks = F.transform(
        F.slice("named", 1, P.FALLBACK_SHOWN), lambda p: F.concat(F.lit("=== p."), p["page_num"].cast("string"), F.lit(" ===\n"), p["text"])
    )
    shown = F.when(hwp & (F.size("named") > 0), F.get("pages", F.lit(0))["text"]).otherwise(F.array_join(blocks, "\n\n"))
    first_named, last_named = F.get("named", F.lit(0))["page_num"], F.element_at(F.reverse("named"), 1)["page_num"]
    some = F.size("named") > 0

    def page(direct_page: Column, named_page: Column) -> Column:
        value = F.when(direct, direct_page).when(some, named_page).otherwise(F.lit(0))
        return F.when(hwp & (direct | some), F.lit(1)).otherwise(value).cast("bigint")

    return rows.select(
        "request_id", "source_file", "article_no",
        F.when(direct, F.col("body")).otherwise(X.strip(shown)).alias("text"),
        page(X.offset_to_page(F.col("start"), F.col("boundaries")), first_named).alias("start_page"),
        page(X.offset_to_page(F.greatest(F.col("start"), F.col("end") - 1), F.col("boundaries")), F.when(some, last_named)).alias("end_page"),
        F.when(direct, "header").when(some, "fallback").otherwise("none").alias("matched_via"),
    )


def verify_lookups(results: DataFrame) -> DataFrame:
    """Whether each lookup (text, error, expect_keywords, expect_error) came out as expected."""
    text = F.coalesce("text", F.lit(""))
    good = (text != "") & F.col("error").isNull() & F.forall("expect_keywords", lambda k: F.contains(text, k))
    bad = F.col("error").isNotNull() & (text == "")
    return results.withColumn("ok", F.when(F.col("expect_error"), bad).otherwise(good))
