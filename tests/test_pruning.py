"""Reports over a table partitioned by message read only the messages they are about."""

from __future__ import annotations

import re

import pytest

from flightlake.operators import select, stats, timejoin
from flightlake.plans import reports
from flightlake.sources.tables import write_by_message

REFS = [("ATT", "Roll"), ("BAT", "Volt")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pruning") / "samples")
    rows = [("x", m, f, i, i * 10, float(i)) for i in range(20) for m, f in [*REFS, ("GPS", "Alt")]]
    schema = "log_id string, message string, field string, seq long, ts_us long, value double"
    write_by_message(spark.createDataFrame(rows, schema), path)
    return spark.read.parquet(path)


def filters(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\], Pushed", plan)


def test_chosen_fields(written):
    assert all("message" in f for f in filters(select.fields(written, REFS)))
    assert select.fields(written, REFS).count() == 40 and select.fields(written, []).count() == 0


def test_statistics_take_the_logs_from_the_catalog(spark, written):
    catalog = spark.createDataFrame([("x",), ("y",)], "log_id string")
    report = reports.window_stats(written, REFS, catalog=catalog)
    found = filters(report)
    assert found and all("message" in f for f in found)
    got = {(r.log_id, r.message): r.n for r in report.collect()}
    assert got == {("x", "ATT"): 20, ("x", "BAT"): 20, ("y", "ATT"): 0, ("y", "BAT"): 0}


def test_instants(spark, written):
    asked = spark.createDataFrame([("x", 55, 0)], "log_id string, ts_us long, seq long")
    found = filters(timejoin.at_instants(written, asked, REFS))
    assert found and all("message" in f for f in found)
    assert stats.column_stats(select.field(written, *REFS[0])).count() == 1
