"""An append-only event log that takes every event once, and counts that grow with it.

Events may come in any order, as late as they like, and more than once: no watermark drops them. Every micro-batch leaves one folder of new events by day and a
small table of counts, and one snapshot names both with the number of the batch. A batch that is run again finds its number taken and changes nothing.
Repeats inside a batch are dropped by their id; repeats of earlier events by a join with the ids of the days that the batch touches, the only ones read.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import settle
from docspark.sources.snapshots import Snapshot, SnapshotTable

FOLD = 64


class EventLog:
    """The log at ``path``: ``schema`` as DDL with an ``id`` and a ``time`` column, and counts by the columns ``keys`` (they may include ``date``)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], id: str = "event_id", time: str = "timestamp"):
        self.spark, self.path, self.id, self.time, self.keys = spark, path.rstrip("/"), id, time, keys
        self.schema = f"{schema}, date date"
        kinds = dict(spark.createDataFrame([], self.schema).dtypes)
        self.columns = list(kinds)
        self.counted = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint"
        self.snapshots = SnapshotTable(spark, self.path, schema, id)

    def _read(self, state: Snapshot, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/{name}" for name in state.notes.get(part, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths] if part == "events" else [self.spark.read.schema(schema).parquet(*paths)]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def events(self) -> DataFrame:
        """All events, each once."""
        return self._read(self.snapshots.snapshot(), "events", self.schema).select(*self.columns)

    def counts(self) -> DataFrame:
        """The key columns and n."""
        return self._read(self.snapshots.snapshot(), "counts", self.counted).groupBy(*self.keys).agg(F.sum("n").alias("n"))

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Take the events of a batch; false if a batch of this or a later number is in the log already. Events without an id cannot repeat."""
        dated = rows.withColumn("date", F.to_date(self.time)).select(*self.columns)
        one = F.min(F.struct(*self.columns)).alias("event")  # equal ids should be equal events; else the least one counts
        once = dated.filter(F.col(self.id).isNotNull()).groupBy(self.id).agg(one).select("event.*").unionByName(dated.filter(F.col(self.id).isNull()))
        arrived, made = settle(once), {}

        def change(state: Snapshot) -> Snapshot | None:
            if batch <= state.notes.get("batch", [-1])[0]:
                return None
            known = tuple(state.notes.get("events", []))
            if known not in made:
                days = [r["date"] for r in arrived.select("date").distinct().collect()]
                old = self._read(state, "events", self.schema).filter(F.col("date").isin(days) | F.col("date").isNull()).select(F.col(self.id).alias("known_id"))
                new = settle(arrived.join(old, F.col(self.id) == F.col("known_id"), "left_anti"))
                made[known] = self._write("events", new, by_day=True), self._write("counts", new.groupBy(*self.keys).agg(F.count("*").alias("n")))
            events, counts = made[known]
            return replace(state, version=state.version + 1, notes=state.noted({"events": [events], "counts": [counts]}) | {"batch": [batch]})

        done = self.snapshots.transact(change)
        if done is not None and len(done.notes["events"]) > FOLD:
            self.fold()
        return done is not None

    def _write(self, part: str, rows: DataFrame, by_day: bool = False) -> str:
        name = uuid.uuid4().hex
        (rows.hint("rebalance", "date").write.partitionBy("date") if by_day else rows.coalesce(1).write).parquet(f"{self.path}/{part}/{name}")
        return name

    def fold(self) -> None:
        """All folders of events as one, and all counts as one."""
        made = {}

        def change(state: Snapshot) -> Snapshot:
            known = tuple(state.notes["events"])
            if known not in made:
                counts = self._read(state, "counts", self.counted).groupBy(*self.keys).agg(F.sum("n").alias("n"))
                made[known] = self._write("events", self._read(state, "events", self.schema), by_day=True), self._write("counts", counts)
            return replace(state, version=state.version + 1, notes=state.notes | {"events": [made[known][0]], "counts": [made[known][1]]})

        self.snapshots.transact(change)


def follow(stream: DataFrame, log: EventLog, checkpoint: str) -> None:
    """Take all events that are there into the log, batch by batch, going on where the checkpoint ends."""

    def take(batch: DataFrame, number: int) -> None:
        log.append(batch, number)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A table of Parquet files as a stream; the path may also be that of one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)
