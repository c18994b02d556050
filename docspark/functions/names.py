"""Document metadata read from file names, and Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docspark import profiles as P
from docspark.functions.text import strip


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; null becomes the empty string."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if x else "")


def extract_date(name: Column) -> Column:
    """(YYYYMMDD) as YYYY-MM-DD, else the empty string."""
    return F.regexp_replace(F.regexp_extract(name, r"\((\d{8})\)", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def infer_doc_type(name: Column) -> Column:
    kind = F.lit(P.DOC_TYPE_DEFAULT)
    for pattern, value in reversed(P.DOC_TYPE_RULES):
        kind = F.when(F.regexp_like(name, F.lit(pattern)), value).otherwise(kind)
    return kind


def clean_doc_name(stem: Column) -> Column:
    """Stem without trailing date and agency brackets; a trailing bracket of plain words becomes the name."""
    dated = strip(F.regexp_replace(stem, r"\s*\([^)]*\d{6,}[^)]*\)\s*$", ""))
    agency = strip(F.regexp_replace(dated, r"\s*\([^)]*\d{4}\)\s*$", ""))
    inner = F.regexp_extract(agency, r"\(([^)]{5,})\)\s*$", 1)
    bare = strip(F.regexp_replace(agency, r"\s*\([^)]*\)\s*$", ""))
    return (
        F.when((inner != "") & ~F.regexp_like(inner, F.lit(r"\d")), strip(inner))
        .when(bare != "", bare).otherwise(stem)
    )


def doc_name(stem: Column) -> Column:
    """Name of the document; an attachment takes its last bracket that looks like a title."""
    brackets = F.filter(
        F.regexp_extract_all(stem, F.lit(r"\(([^)]+)\)"), F.lit(1)),
        lambda s: ~F.regexp_like(s, F.lit(r"\d{6,}")) & (F.length(s) > 4),
    )
    attached = F.regexp_like(stem, F.lit(P.ATTACHMENT_NAME)) & (F.size(brackets) > 0)
    return F.when(attached, F.element_at(brackets, -1)).otherwise(clean_doc_name(stem))


def doc_metadata(stem: Column) -> dict[str, Column]:
    date = extract_date(stem)
    return {
        "doc_name": doc_name(stem), "doc_type": infer_doc_type(stem), "effective_date": date, "revised_date": date,
        "is_current": F.lit(True),
    }
