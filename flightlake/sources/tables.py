"""Writing decoded logs so that later questions read little."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.scale import scratch_table

ORDER = ("log_id", "ts_us", "seq")
#: Rows a file is meant to hold: some hundred MB of samples.
FILE_ROWS = 8_000_000


def write_by_message(rows: DataFrame, path: str, mode: str = "overwrite", file_rows: int = FILE_ROWS) -> None:
    """Parquet partitioned by message, each file sorted by log and time.

    Rows are range-partitioned first, so a message that makes up much of the
    fleet is written by many tasks, and min/max statistics on log and time let
    a reader skip row groups.  How many ranges there are follows from the rows,
    not from the session: no more files than messages and ``file_rows`` make.
    Rows are written down as they come before that, so what makes them runs once,
    not again to sample where ranges begin.
    """
    staged = scratch_table(rows, "unsorted")
    parts = max(1, math.ceil(staged.count() / file_rows))
    (
        staged.repartitionByRange(parts, "message", *ORDER)
        .sortWithinPartitions("message", *ORDER)
        .write.mode(mode).partitionBy("message").parquet(path)
    )


def read_by_message(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# What is live of an ingested table is told by a manifest: one row for each run of
# batches that was merged.  A row is added when all of a run's files are there, so a
# reader sees the batches or the files they were merged into, never both or neither.

MANIFEST = "folder string, first_batch long, last_batch long"


def _manifest(spark: SparkSession, merged: str) -> DataFrame:
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{merged}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{merged}/manifest")


def merge_batches(spark: SparkSession, batches: str, merged: str, file_rows: int = FILE_ROWS) -> int:
    """Merge the batch folders ``ingest`` has written since the last time; how many they were.

    Their rows are written once more, by message and of full size; batch folders stay until
    someone removes what the manifest covers.  A run that fails leaves files no row names,
    and is simply run again.
    """
    last = _manifest(spark, merged).agg(F.max("last_batch")).first()[0]
    rows = spark.read.parquet(batches).where(F.col("batch") > (-1 if last is None else last))
    ends = rows.agg(F.min("batch"), F.max("batch"), F.count_distinct("batch")).first()
    if ends[0] is None:
        return 0
    folder = f"batches-{ends[0]}-{ends[1]}"
    write_by_message(rows.drop("batch"), f"{merged}/files/{folder}", file_rows=file_rows)
    row = [(folder, int(ends[0]), int(ends[1]))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{merged}/manifest")
    return ends[2]


def read_ingested(spark: SparkSession, batches: str, merged: str) -> DataFrame:
    """All ingested rows: merged ones by message, the batches since as they came."""
    live = sorted(_manifest(spark, merged).collect())
    last = max((r["last_batch"] for r in live), default=-1)
    fresh = spark.read.parquet(batches).where(F.col("batch") > last).drop("batch")
    if not live:
        return fresh
    # Each folder once, however often a run of it was told.
    folders = dict.fromkeys(f"{merged}/files/{r['folder']}" for r in live)
    parts = [spark.read.parquet(f) for f in folders]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*fresh.columns).unionByName(fresh)
