from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from flightlake import scale  # noqa: E402
from flightlake.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(params=["whole", "split"])
def grouping(request, monkeypatch):
    """Run a case as usual and with every group of more than five rows split."""
    if request.param == "split":
        monkeypatch.setattr(scale, "GROUP_ROWS", 5)
    return request.param


@pytest.fixture
def series(spark):
    """Samples of several logs: ``series({"log": [(ts, value), ...]})``."""

    def build(logs, message="M", field="f"):
        rows = [
            (log, message, field, seq, int(ts), None if value is None else float(value))
            for log, points in logs.items()
            for seq, (ts, value) in enumerate(points)
        ]
        return spark.createDataFrame(
            rows, "log_id string, message string, field string, seq long, ts_us long, value double"
        )

    return build
