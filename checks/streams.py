"""Streams over the driver's tables, driven to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import check, rounded
from flightlake.scale import scratch_dir
from flightlake.sources.tables import merge_batches, read_ingested
from flightlake.streaming import live


def _events(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _fresh(spark):
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


@check("t04_live_stats", """
    SELECT log_id, message, epoch_us(day) AS day_us, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM (
        SELECT CAST(user_id % 4 AS VARCHAR) AS log_id, event_type AS message, date_trunc('day', ts) AS day, value FROM events) e
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY log_id, message, day""")
def t04_stats(spark, d):
    """Windows are emitted once the watermark has passed them; the last stays open."""
    rows = _events(spark, d).select(
        (F.col("user_id") % 4).cast("string").alias("log_id"), F.col("event_type").alias("message"), F.lit("value").alias("field"),
        F.col("ts").cast("timestamp").alias("at"), "value",
    )
    out = _fresh(spark)
    query = (
        live.live_stats(rows, "1 day", "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{out}-mark")
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    found = spark.read.parquet(out)
    return rounded(found.select("log_id", "message", F.unix_micros("window.start").alias("day_us"), "n", "mean", "max"))


@check("t04_live_modes", """
    SELECT log_id, seq, mode FROM (
        SELECT CAST(user_id % 4 AS VARCHAR) AS log_id, event_id AS seq, event_type AS mode, lag(event_type) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS p FROM events) e
    WHERE p IS NULL OR p <> mode""")
def t04_modes(spark, d):
    rows = _events(spark, d).select(
        (F.col("user_id") % 4).cast("string").alias("log_id"), F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_type").alias("mode"),
    )
    out = _fresh(spark)
    live.follow_modes(rows, out, f"{out}-mark").awaitTermination()
    return spark.read.parquet(out).select("log_id", "seq", "mode")


@check("t03_ingest_and_merge", """
    SELECT CAST(user_id % 4 AS VARCHAR) AS log_id, event_type AS message, event_id AS seq, value FROM events""")
def t03(spark, d):
    """A folder that fills in two steps: ingested, merged, filled again; all rows once, by message."""
    out = _fresh(spark)
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        (F.col("user_id") % 4).cast("string").alias("log_id"), F.col("event_type").alias("message"),
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value",
    )
    schema = rows.schema
    for step in (0, 1):
        rows.where(F.col("seq") % 2 == step).repartition(3).write.mode("append").parquet(f"{out}/in")
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
        live.ingest(arriving, lambda files: files, f"{out}/batches", f"{out}/mark").awaitTermination()
        if step == 0:
            merge_batches(spark, f"{out}/batches", f"{out}/merged")
    return read_ingested(spark, f"{out}/batches", f"{out}/merged").select("log_id", "message", "seq", "value")
