"""Audit log, library and answer-cache jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import profiles as P


def audit_events(answered: DataFrame) -> DataFrame:
    """One audit row per answered question; its timestamp is the end of the answer."""
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    return answered.select(
        F.date_trunc("second", "ended_at").alias("timestamp"), F.date_trunc("second", "started_at").alias("started_at"),
        F.date_trunc("second", "ended_at").alias("ended_at"), F.round(seconds, 2).alias("duration_sec"), "question",
        "verdict", F.round("confidence", 1).alias("confidence"), "citations_count", "follow_up", "mcp_used", "web_used",
    )


def usage_kpis(audit: DataFrame, as_of: Column) -> DataFrame:
    """Questions in all and on one day, share with outside tools and with follow-up in whole percent."""

    def percent(flag: str) -> Column:
        return F.round(F.avg(F.col(flag).cast("double")) * 100, 0)

    return audit.agg(
        F.count("*").alias("n_questions"), F.count(F.when(F.to_date("timestamp") == as_of, 1)).alias("n_on_day"),
        percent("mcp_used").alias("mcp_pct"), percent("follow_up").alias("follow_up_pct"),
    )


def daily_questions(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n"))


def verdict_distribution(audit: DataFrame) -> DataFrame:
    return audit.groupBy("verdict").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict")


def confidence_histogram(audit: DataFrame) -> DataFrame:
    """Right-closed bins, all of them listed; a confidence of exactly zero falls into none."""
    c = F.col("confidence")
    bins = list(zip(P.CONFIDENCE_LABELS, P.CONFIDENCE_BINS, P.CONFIDENCE_BINS[1:]))
    counted = audit.agg(*[F.count(F.when((c > low) & (c <= high), 1)).alias(label) for label, low, high in bins])
    rows = F.array(
        *[F.struct(F.lit(i).cast("bigint").alias("bin_no"), F.lit(b[0]).alias("bin"), F.col(f"`{b[0]}`").alias("n"))
          for i, b in enumerate(bins)]
    )
    return counted.select(F.inline(rows))


def audit_recent(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.desc("timestamp"))


def name_filter(rows: DataFrame, column: str, pattern: str, kind: str, kinds: list[str]) -> DataFrame:
    """Case-blind pattern on one column and a list of allowed values on another; an empty list allows all."""
    if pattern:
        rows = rows.filter(F.regexp_like(F.col(column), F.lit("(?i)" + pattern)))
    return rows.filter(F.col(kind).isin(*kinds)) if kinds else rows


def library_summary(chunks: DataFrame) -> DataFrame:
    """Per document name and type: chunks, last page, and dates, currency and file of the first chunk."""
    first = F.min_by(F.struct("effective_date", "revised_date", "is_current", "source_file"), F.col("chunk_id"))
    return (
        chunks.groupBy("doc_name", "doc_type")
        .agg(F.count("*").alias("n_chunks"), F.max("page").alias("n_pages"), first.alias("first"))
        .select("doc_name", "doc_type", "n_chunks", "n_pages", "first.*")
    )


def cache_key() -> Column:
    """sha256 of the question and the options that shape its answer."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)).cast("int").cast("string")

    parts = (
        ("q", F.trim(text("question"))), ("dt", text("doc_type_filter")), ("mcp", flag("use_mcp")),
        ("web", flag("use_web")), ("model", text("model")), ("kind", text("kind")), ("doc", F.trim(text("doc_name_hint"))),
    )
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(name + "="), value) for name, value in parts]), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (cache_key, ...) with the cached answer, or a miss."""
    return requests.join(cache, "cache_key", "left").withColumn("hit", F.col("saved_at").isNotNull())


def cache_upsert(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Latest answer per key; abstentions and blank verdicts are not stored."""
    verdict = F.trim(F.coalesce("verdict", F.lit("")))
    fresh = answers.filter((verdict != "") & (verdict != P.ABSTAIN))
    columns = [c for c in cache.columns if c != "cache_key"]
    everything = cache.unionByName(fresh.select(*cache.columns))
    latest = F.max_by(F.struct(*columns), F.col("saved_at"))
    return everything.groupBy("cache_key").agg(latest.alias("row")).select("cache_key", "row.*")


def cache_invalidate(cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Cache rows of the given chunker version, and the number cleared."""
    kept = cache.filter(F.col("chunker_version") == version)
    return kept, cache.agg(F.count(F.when(F.col("chunker_version") != version, 1)).alias("n_cleared"))
