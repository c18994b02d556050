"""Outcomes of calls per channel: hourly counts as a stream, and runs of failures as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark import profiles as P
from docspark.streaming.audit import EventLog


def outcome_log(spark: SparkSession, path: str) -> EventLog:
    """A log of calls (event_id, channel, ts, ok) that counts them by channel, hour and outcome."""
    return EventLog(spark, path, "event_id bigint, channel bigint, ts timestamp, ok boolean, hour timestamp", ["date", "channel", "hour", "ok"], time="ts")


def hourly_outcomes(log: EventLog) -> DataFrame:
    """channel, hour, n_ok, n_failed of all calls in the log."""
    n = lambda ok: F.coalesce(F.sum(F.when(F.col("ok") == ok, F.col("n"))), F.lit(0))
    return log.counts().groupBy("channel", "hour").agg(n(True).alias("n_ok"), n(False).alias("n_failed"))


def failure_runs(calls: DataFrame) -> DataFrame:
    """channel, first_ts, last_ts, n_failures, trips of every run of failures between two successes of a channel.

    A run is named by the number of successes before it. Successes are counted per channel and day, summed up over the days, and
    counted on inside a day, so a busy channel is many groups. ``trips``: the run is as long as the breaker's limit.
    """
    rows = calls.withColumn("day", F.to_date("ts"))
    ok = F.col("ok").cast("bigint")
    earlier = F.sum("n").over(W.partitionBy("channel").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    days = rows.groupBy("channel", "day").agg(F.sum(ok).alias("n")).select("channel", "day", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = W.partitionBy("channel", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    counted = rows.withColumn("inside", F.sum(ok).over(inside)).join(days, ["channel", "day"])
    failed = counted.filter(~F.col("ok")).groupBy("channel", (F.col("before") + F.col("inside")).alias("run"))
    runs = failed.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_failures"))
    return runs.select("channel", "first_ts", "last_ts", "n_failures", (F.col("n_failures") >= P.BREAKER_LIMIT).alias("trips"))
