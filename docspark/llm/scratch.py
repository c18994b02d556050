"""Written intermediate tables whose shuffle files go as soon as the table is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docspark import session

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from the table.

    Nothing reads the shuffles behind a complete table again, so Spark removes their files with the write. ``rows`` bounds an Arrow batch. Both settings
    are put back.
    """
    conf = df.sparkSession.conf
    wanted = {CLEAN_UP: "true"} | ({RECORDS: str(rows)} if rows else {})
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        return session.settle(df)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def discard(table: DataFrame) -> None:
    """Delete a table that ``settle`` made, once every table made of it is complete."""
    files = table.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        if "/step-" in folder:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settle_wide(df: DataFrame) -> DataFrame:
    """``settle`` for rows that hold whole token sets or texts: 1000 of them in an Arrow batch at most."""
    return settle(df, 1000)
