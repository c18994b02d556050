"""Page text: running heads, headings, tables, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.functions.text import is_blank, strip


def is_running_line(line: Column) -> Column:
    s = strip(line)
    numbered = (F.length(s) <= P.RUNNING_MAX_CHARS) & F.regexp_like(s, F.lit(r"\d"))
    return (s == "") | F.regexp_like(s, F.lit(P.RUNNING_NUMBER)) | numbered


def _leading(flags: Column, limit: int) -> Column:
    """How many of the first ``limit`` flags are true before the first false one."""
    count = F.lit(0)
    for n in range(limit, 0, -1):
        all_true = F.forall(F.slice(flags, 1, n), lambda f: f) & (F.size(flags) >= n)
        count = F.when((count == 0) & all_true, n).otherwise(count)
    return count


def strip_running_heads(text: Column) -> Column:
    """Text without its running lines: two at the top and three at the bottom at most."""
    lines = F.split(text, P.LINE_BREAKS)
    flags = F.transform(lines, is_running_line)
    head = _leading(flags, P.RUNNING_HEAD_MAX)
    foot = _leading(F.reverse(flags), P.RUNNING_FOOT_MAX)
    kept = F.slice(lines, head + 1, F.greatest(F.size(lines) - head - foot, F.lit(0)))
    return strip(F.array_join(kept, "\n"))


def md_headings(text: Column) -> Column:
    """Article header lines as second-level headings, short appendix and addendum lines as third-level ones."""

    def line(c: Column) -> Column:
        s = strip(c)
        small = (F.regexp_like(s, F.lit(P.HEADING_APPENDIX)) & (F.length(s) < 30)) | (
            F.regexp_like(s, F.lit(P.HEADING_ADDENDUM)) & (F.length(s) < 20)
        )
        return (
            F.when(F.regexp_like(s, F.lit(P.HEADING_ARTICLE)), F.concat(F.lit("\n## "), s))
            .when(small, F.concat(F.lit("\n### "), s)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, P.LINE_BREAKS), line), "\n")


def table_text(cells: Column) -> Column:
    """array<array<string>> as lines of cells joined by a bar."""
    return F.array_join(
        F.transform(cells, lambda row: F.array_join(F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))), " | ")),
        "\n",
    )


def table_markdown(cells: Column) -> Column:
    """array<array<string>> as a Markdown table with a separator after the first row."""
    rows = F.transform(
        cells,
        lambda row: F.concat(
            F.lit("| "),
            F.array_join(F.transform(row, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))), " | "),
            F.lit(" |"),
        ),
    )
    dashes = F.array_join(F.array_repeat(F.lit("---"), F.size(F.get(cells, F.lit(0)))), " | ")
    separator = F.concat(F.lit("| "), dashes, F.lit(" |"))
    ordered = F.concat(F.slice(rows, 1, 1), F.array(separator), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
    return F.when(F.size(cells) > 0, F.array_join(ordered, "\n")).otherwise("")


def needs_ocr(text: Column) -> Column:
    return F.length(strip(text)) < P.OCR_MIN_CHARS


def looks_failed(text: Column) -> Column:
    """No text, or a known failure message at its head."""
    head = F.left(F.ltrim(text), F.lit(P.FAILURE_HEAD_CHARS))
    failed = is_blank(F.coalesce(text, F.lit("")))
    for message in P.PARSE_FAILURES:
        failed = failed | F.startswith(head, F.lit(message))
    return failed


def structure_counts(text: Column) -> dict[str, Column]:
    counts = {
        name: F.regexp_count(text, F.lit(pattern)).cast("bigint")
        for name, pattern in (
            ("n_articles", P.ARTICLE_TOKEN), ("n_appendices", P.APPENDIX_TOKEN), ("n_addenda", P.ADDENDUM_TOKEN)
        )
    }
    return {**counts, "warn": counts["n_articles"] == 0}


def markdown_document(source_file: Column, pages: Column) -> Column:
    """Whole document as Markdown: title, source line, page markers and headed text."""
    stem = F.regexp_replace(source_file, r"\.[^.]+$", "")
    head = F.array(F.concat(F.lit("# "), stem, F.lit("\n")), F.concat(F.lit("> 출처: "), source_file, F.lit("\n")), F.lit("---\n"))

    def page(p: Column) -> Column:
        body = strip_running_heads(p["text"])
        marker = F.concat(F.lit("\n<!-- PAGE "), p["page_num"].cast("string"), F.lit(" -->\n"))
        return F.when(body == "", marker).otherwise(F.concat_ws("\n", marker, md_headings(body)))

    text = F.array_join(F.concat(head, F.transform(pages, page)), "\n")
    return F.regexp_replace(text, r"\n{4,}", "\n\n\n")


def raw_dump(pages: Column) -> Column:
    """=== PAGE n === blocks in page order."""
    return F.array_join(
        F.transform(
            pages, lambda p: F.concat(F.lit("=== PAGE "), p["page_num"].cast("string"), F.lit(" ===\n"), p["text"], F.lit("\n\n"))
        ),
        "",
    )
