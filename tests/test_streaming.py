"""Directories that fill up and tables that grow, driven to completion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flightlake.sources import tables
from flightlake.sources.dataflash import read_dataflash
from flightlake.streaming import live
from tests.logwriter import GPS, gps


def test_arriving_logs_are_ingested_once(spark, tmp_path):
    drop, out, mark = tmp_path / "drop", tmp_path / "out", tmp_path / "mark"
    drop.mkdir()

    def run():
        files = live.arriving_files(spark, str(drop))
        live.ingest(files.where("kind = 'bin'"), read_dataflash, str(out), str(mark)).awaitTermination()
        return spark.read.parquet(str(out)).groupBy("log_id").count().count(), spark.read.parquet(str(out)).count()

    (drop / "a.bin").write_bytes(GPS + gps(1, 1, 1, 1) + gps(2, 1, 1, 1))
    (drop / "skip.tlog").write_bytes(b"\0" * 30)
    assert run() == (1, 2)
    (drop / "b.bin").write_bytes(GPS + gps(3, 1, 1, 1))
    assert run() == (2, 3)
    assert run() == (2, 3)
    # Without a telling name the first byte decides.
    (drop / "no telling %20name").write_bytes(b"\xa3" + (GPS + gps(4, 1, 1, 1))[1:])
    (drop / "other").write_bytes(b"\0" * 30)
    assert run() == (3, 4)


def test_batches_are_merged_while_readers_go_on(spark, tmp_path):
    batches, merged, mark = str(tmp_path / "batches"), str(tmp_path / "merged"), str(tmp_path / "mark")
    schema = "log_id string, message string, seq long, ts_us long, value double"
    rows = [(f"log{i % 3}", "ABC"[i % 3], i, 1000 - i, float(i)) for i in range(60)]

    def feed(part):
        spark.createDataFrame(part, schema).repartition(4).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.ingest(arriving, lambda files: files, batches, mark).awaitTermination()

    def held(df):
        return sorted(map(tuple, df.select("log_id", "message", "seq", "ts_us", "value").collect()))

    feed(rows[:30])
    before = tables.read_ingested(spark, batches, merged)
    assert held(before) == sorted(rows[:30])
    assert tables.merge_batches(spark, batches, merged, file_rows=20) == 4
    assert tables.merge_batches(spark, batches, merged) == 0
    # A view taken before still reads what it saw; one taken now reads merged files.
    after = tables.read_ingested(spark, batches, merged)
    assert held(before) == held(after) == sorted(rows[:30])
    assert 3 <= len([f for f in after.inputFiles() if "/merged/" in f]) <= 5
    feed(rows[30:])
    both = tables.read_ingested(spark, batches, merged)
    assert held(both) == sorted(rows)
    assert tables.merge_batches(spark, batches, merged) == 4
    last = tables.read_ingested(spark, batches, merged)
    assert held(last) == sorted(rows)
    plan = last.where("message = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "PartitionFilters: [isnotnull(message" in x]) == 2
    # Files without a row in the manifest, as a failed run leaves them, are not read.
    spark.createDataFrame(rows, schema).write.partitionBy("message").parquet(f"{merged}/files/batches-8-9")
    assert tables.read_ingested(spark, batches, merged).count() == 60


def test_modes_are_followed_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "log_id string, seq long, ts_us long, mode string"
    written = []

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = live.follow_modes(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
        query.awaitTermination()
        written.append(query.lastProgress["stateOperators"][0]["numRowsUpdated"])
        found = spark.read.schema(schema).parquet(str(tmp_path / "out"))
        return sorted((r.log_id, r.seq, r["mode"]) for r in found.collect())

    assert feed(("x", 0, 0, "A"), ("x", 1, 1, "A"), ("y", 0, 0, "Q")) == [("x", 0, "A"), ("y", 0, "Q")]
    assert feed(("x", 2, 2, "A"), ("x", 3, 3, "B")) == [("x", 0, "A"), ("x", 3, "B"), ("y", 0, "Q")]
    assert feed(("y", 1, 1, "Q"), ("y", 2, 2, "R"), ("x", 4, 4, "B")) == [("x", 0, "A"), ("x", 3, "B"), ("y", 0, "Q"), ("y", 2, "R")]
    # Only a log whose label has changed has its state written.
    assert written == [2, 1, 1]
    # Rows of a batch come in any order; labels and stamps may be missing.
    assert feed(("z", 3, None, None), ("z", 1, 1, "A"), ("z", 2, 2, None), ("x", 5, 5, None))[2:3] == [("x", 5, None)]
    got = spark.read.schema(schema).parquet(str(tmp_path / "out")).where("log_id = 'z'").collect()
    assert sorted((r.seq, r.ts_us, r["mode"]) for r in got) == [(1, 1, "A"), (2, 2, None)]


def test_live_stats_drop_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    schema = "log_id string, message string, field string, at timestamp, value double"
    start = dt.datetime(2024, 1, 1)

    def feed(minutes):
        rows = [("x", "M", "f", start + dt.timedelta(minutes=m), float(m)) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    source.mkdir()
    stats = live.live_stats(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), late="5 minutes")

    def run():
        query = (
            stats.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "mark"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).select(F.minute("window.start").alias("m"), "n", "mean").collect()
        return {r.m: (r.n, r["mean"]) for r in rows}

    feed([0, 0, 1, 20])
    run()
    feed([0, 30])  # minute 0 is closed: this row is late
    got = run()
    assert got[0] == (2, 0.0) and got[1] == (1, 1.0)
