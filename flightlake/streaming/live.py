"""Logs that keep arriving, and tables that keep growing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flightlake.operators.stats import stat_columns
from flightlake.session import ship
from flightlake.sources.files import with_kind

# The columns of the file listing source.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MODE_ROWS = "log_id string, seq long, ts_us long, mode string"
#: Stands for a missing stamp among numbers.
NO_STAMP = np.iinfo(np.int64).min


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of ``(log_id, path, length, kind)``, one row per new file; at most its first byte is read."""
    listed = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    return with_kind(listed)


def ingest(
    arriving: DataFrame, decode: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger: Any
) -> StreamingQuery:
    """Decode each batch of new files and write its records.

    A batch owns the folder named by its number and replaces it, so a batch run
    twice after a failure leaves its records once.
    """

    def write(files: DataFrame, batch: int) -> None:
        decode(files).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


class LastMode(StatefulProcessor):
    """Remembers the latest label of a log, and tells where the label changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "mode string, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # A batch's rows of a log come in any order: their places and labels, as numbers, are put in order here.
        labels: dict[str | None, int] = {}
        places, stamps, codes = [], [], []
        for part in rows:
            places.append(part["seq"].to_numpy(np.int64))
            stamps.append(part["ts_us"].astype("Int64").to_numpy(np.int64, na_value=NO_STAMP))
            mode = part["mode"].where(part["mode"].notna(), None)
            codes.append(np.array([labels.setdefault(m, len(labels)) for m in mode], np.int32))
        place, stamp, code = (np.concatenate(x) for x in (places, stamps, codes))
        order = np.argsort(place, kind="stable")
        place, stamp, code = place[order], stamp[order], code[order]
        known = self.last.get()
        changed = np.ones(len(code), bool)
        changed[1:] = code[1:] != code[:-1]
        names = list(labels)
        changed[0] = known is None or known[0] != names[code[0]]
        if known is None or known[0] != names[code[-1]]:
            self.last.update((names[code[-1]], True))
        at = np.flatnonzero(changed)
        yield pd.DataFrame(
            {
                "log_id": key[0],
                "seq": place[at],
                "ts_us": pd.arrays.IntegerArray(stamp[at], stamp[at] == NO_STAMP),
                "mode": pd.Series([names[c] for c in code[at]], dtype=object),
            }
        )

    def close(self) -> None:
        pass


def follow_modes(labelled: DataFrame, out: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Write mode changes of a live stream of ``(log_id, seq, ts_us, mode)``, rows of a log in file order.

    What must be remembered between batches is the last label of each log: keyed state,
    one value a log, kept by the state store beside the checkpoint.  A batch reads the
    state of the logs it holds and writes that of those whose label has changed; logs it
    does not touch cost nothing.  A log's rows of one batch meet in one task as numbers,
    so the source's batch size (files or bytes a trigger) is what bounds them.
    """
    spark = labelled.sparkSession
    ship(spark)
    # Several values by key, with a log of changes instead of whole snapshots.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    changes = (
        labelled.select("log_id", "seq", "ts_us", "mode").groupBy("log_id")
        .transformWithStateInPandas(LastMode(), MODE_ROWS, "append", "none")
    )
    return (
        changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start(out)
    )


def live_stats(samples: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Statistics per series and tumbling window of a live stream.

    ``samples`` carries ``at`` (TIMESTAMP).  Rows later than ``late`` are
    dropped by the watermark; a window is emitted once it can no longer change.
    """
    return (
        samples.withWatermark("at", late)
        .groupBy("log_id", "message", "field", F.window("at", width))
        .agg(*stat_columns(F.col("value")))
    )
