"""Event logs that take every event once, whatever the order of the files."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docspark.sources.snapshots import SnapshotTable
from docspark.streaming import audit, outcomes

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, timestamp timestamp, verdict string"


def part(folder, no, rows):
    ids, times, verdicts = zip(*rows)
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "timestamp": pa.array(times, pa.timestamp("us", tz="UTC")), "verdict": pa.array(verdicts)}), folder / f"part-{no:04d}.parquet")


def event(i):
    return i, START + timedelta(hours=7 * i), ("ok", "open", "no")[i % 3]


def daily(events):
    return Counter((e[1].date(), e[2]) for e in events)


def counted(log):
    return {(r.date, r.verdict): r.n for r in log.counts().collect()}


def new_log(spark, path):
    return audit.EventLog(spark, str(path), SCHEMA, ["date", "verdict"])


@pytest.mark.parametrize("fold", [audit.FOLD, 1])
def test_shuffled_parts_with_repeats(spark, tmp_path, monkeypatch, fold):
    """200 part files in random order, newest first in places, with repeats in other files and in the same one."""
    monkeypatch.setattr(audit, "FOLD", fold)
    rng, source = random.Random(4), tmp_path / "events.parquet"
    order = list(range(200))
    rng.shuffle(order)
    for no, i in enumerate(order):
        part(source, no, [event(i)] + ([event(order[rng.randrange(no + 1)])] if no % 3 == 0 else []) + ([event(i)] if no % 7 == 0 else []))
    log = new_log(spark, tmp_path / "log")
    rows = audit.read_log(spark, str(source), SCHEMA)
    audit.follow(rows, log, str(tmp_path / "state"))
    assert counted(log) == daily(map(event, range(200))) and log.events().count() == 200
    part(source, 900, [event(3), event(500), (None, START, "ok"), (None, START, "ok")])
    audit.follow(audit.read_log(spark, str(source), SCHEMA), log, str(tmp_path / "state"))
    assert counted(log) == daily([*map(event, [*range(200), 500]), (None, START, "ok"), (None, START, "ok")])


def test_one_file_is_a_log_too(spark, tmp_path):
    part(tmp_path / "in", 1, [event(i) for i in range(9)])
    part(tmp_path / "in", 2, [event(i) for i in range(50, 60)])
    log = new_log(spark, tmp_path / "log")
    audit.follow(audit.read_log(spark, str(tmp_path / "in" / "part-0001.parquet"), SCHEMA), log, str(tmp_path / "state"))
    assert counted(log) == daily(map(event, range(9)))


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    """A batch that stops before its snapshot is run again; one that is in the log is not taken again."""
    log = new_log(spark, tmp_path / "log")
    frame = lambda *ids: spark.createDataFrame([event(i) for i in ids], SCHEMA)
    assert log.append(frame(1, 2), 0) and not log.append(frame(1, 2, 3), 0)
    with monkeypatch.context() as patch:
        patch.setattr(SnapshotTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            log.append(frame(2, 4), 1)
    assert counted(log) == daily(map(event, (1, 2)))
    assert log.append(frame(2, 4), 1)
    assert counted(log) == daily(map(event, (1, 2, 4)))


def test_outcomes_by_hour(spark, tmp_path):
    calls = [(i, i % 2, START + timedelta(minutes=17 * i), i % 5 > 1) for i in range(60)]
    log = outcomes.outcome_log(spark, str(tmp_path / "log"))
    schema = "event_id bigint, channel bigint, ts timestamp, ok boolean"
    for no, at in enumerate((40, 0, 20)):
        rows = spark.createDataFrame(calls[at : at + 25], schema)
        log.append(rows.selectExpr("*", "date_trunc('hour', ts) AS hour"), no)
    got = {(r.channel, r.hour): (r.n_ok, r.n_failed) for r in outcomes.hourly_outcomes(log).collect()}
    want = {}
    for _, channel, ts, ok in calls:
        hour = ts.replace(minute=0)
        a, b = want.get((channel, hour), (0, 0))
        want[channel, hour] = (a + ok, b + (not ok))
    assert got == want
