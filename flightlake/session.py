"""Session settings every job relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, whose workers import it by name. Once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="flightlake-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "flightlake"), "zip", os.path.dirname(_PACKAGE), os.path.basename(_PACKAGE)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """UTC clocks (microsecond stamps are epoch based) and adaptive execution.

    Partition counts are left to the cluster; adaptive execution merges small
    shuffle partitions and splits skewed join partitions at run time.  Parsing
    and fitting cost much per byte, so small partitions are merged less eagerly
    than by default.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A median holds a whole group's values: few groups at a time per task.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "32")
    # Of a key that a plan file repeats, the last value counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    ship(spark)
    return spark
