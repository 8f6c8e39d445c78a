"""Telemetry link logs: a wall-clock stamp and one MAVLink frame per record.

Which fields a message has comes from a user-supplied table
``dialect(msg_id, msg_name, field, type, offset, size, array_len, layer)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.sources.dataflash import ROWS_PER_BATCH, _text, known_numbers, map_column
from flightlake.sources.files import byte_ranges, indexed, is_index, range_bytes_of, settle_ranges, settled, told_batches

# Frame markers, the flag for a signed frame and its extra bytes.
V1, V2 = 0xFE, 0xFD
SIGNED_FLAG, SIGNATURE = 0x01, 13

# Scalar types and their numpy layout.
SCALARS = {
    "uint8_t": "u1", "int8_t": "i1", "uint16_t": "<u2", "int16_t": "<i2", "uint32_t": "<u4",
    "int32_t": "<i4", "uint64_t": "<u8", "int64_t": "<i8", "float": "<f4", "double": "<f8", "char": "S1",
}

#: Bytes of ranges that are decoded at once: short ones share a batch of records.
TOGETHER = 1 << 20

#: Stamps are microseconds in 63 bits; what a resync through junk may read beyond is none.
LAST_STAMP = 2**63 - 1

FRAMES = "log_id string, seq long, ts_us long, msg_id int, payload binary, size int"
RECORDS = (
    "log_id string, source string, seq long, msg_type int, message string, ts_us long, "
    "nums map<string,double>, txts map<string,string>"
)


def layered_dialect(dialect: DataFrame) -> DataFrame:
    """Messages of stacked dialects: the highest layer defining an id wins whole."""
    top = dialect.groupBy("msg_id").agg(F.max("layer").alias("layer"))
    return dialect.join(top, ["msg_id", "layer"])


def _scan(row: dict) -> tuple[list[tuple[int, int, int, int, int]], bytes, int, int]:
    """``(position, msg_id, payload position, payload length, end)`` in one byte range."""
    base = row["start"]
    buf = range_bytes_of(row)
    n, stop, pos = len(buf), row["hi"] - base, 0
    at_end = base + n >= row["length"]
    found = []
    while pos < stop and pos + 8 <= n:
        p = pos + 8
        mark = buf[p] if p < n else -1
        if mark == V2 and p + 10 <= n:
            size, first, msg_id = buf[p + 1], p + 10, buf[p + 7] | buf[p + 8] << 8 | buf[p + 9] << 16
            end = first + size + 2 + (SIGNATURE if buf[p + 2] & SIGNED_FLAG else 0)
        elif mark == V1 and p + 6 <= n:
            size, first, msg_id = buf[p + 1], p + 6, buf[p + 5]
            end = first + size + 2
        elif mark in (V1, V2):
            end = n + 1
        else:
            pos += 1
            continue
        if end > n:
            # Only the end of the file cuts a frame short, and that ends the log.
            pos = max(stop, pos) if not at_end else stop
            return found, buf, base, row["length"]
        found.append((pos, msg_id, first, size, end))
        pos = end
    return found, buf, base, max(row["hi"], base + pos)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return told_batches(_told(row) for batch in batches for row in batch.to_pylist())


def _told(row: dict) -> dict:
    found, _, base, end = _scan(row) if row["start"] < row["hi"] else ([], b"", 0, row["start"])
    early = [base + f[0] for f in found[:1024]]
    return {**row, "end": end, "declared": b"", "early": early, "last_clock": None, "seen": []}


@dataclass
class _Run:
    """Bytes of several ranges after one another, their frames by place there (as ``_scan`` tells
    them), and of each frame its log and where in its file the bytes begin that it is counted from."""

    buf: bytes
    frames: np.ndarray
    logs: pa.Array
    bases: np.ndarray

    def stamps(self, part: np.ndarray) -> pa.Array:
        raw = np.frombuffer(self.buf, np.uint8)[part[:, :1] + np.arange(8)]
        told = np.ascontiguousarray(raw).view(">u8").ravel()
        return pa.array(told.astype(np.int64), pa.int64(), mask=told > LAST_STAMP)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    def joined() -> _Run:
        counts = np.array([len(frames) for _, _, frames, _ in held])
        shifts = np.cumsum([0] + [len(buf) for _, buf, _, _ in held])[:-1]
        frames = np.concatenate([frames for _, _, frames, _ in held])
        frames[:, [0, 2, 4]] += np.repeat(shifts, counts)[:, None]
        logs = pa.array([log for log, _, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
        bases = np.repeat(np.array([base for _, _, _, base in held], np.int64) - shifts, counts)
        return _Run(b"".join(buf for _, buf, _, _ in held), frames, logs, bases)

    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["start"] >= row["hi"]:
                continue
            found, buf, base, _ = _scan(row)
            if found:
                held.append((row["log_id"], buf, np.array(found, np.int64), base))
                size += len(buf)
            if size >= TOGETHER:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        for cut in range(0, len(run.frames), ROWS_PER_BATCH):
            part, bases = run.frames[cut : cut + ROWS_PER_BATCH], run.bases[cut : cut + ROWS_PER_BATCH]
            payloads = [run.buf[a : a + n] for a, n in part[:, 2:4].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    run.logs.slice(cut, len(part)),
                    pa.array(part[:, 0] + bases, pa.int64()),
                    run.stamps(part),
                    pa.array(part[:, 1], pa.int32()),
                    pa.array(payloads, pa.binary()),
                    pa.array(part[:, 4] - part[:, 0], pa.int32()),
                ],
                names=["log_id", "seq", "ts_us", "msg_id", "payload", "size"],
            )


def settled_ranges(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Ranges to read, of files or of a stored index (``index``)."""
    return settled(files) if is_index(files) else settle_ranges(byte_ranges(files, range_bytes), _summarise, declares=False)


def index(files: DataFrame, folder: str, range_bytes: int | None = None) -> DataFrame:
    """Files as ranges that need no framing again; new or grown ones are framed and added to ``folder``."""
    return indexed(files, folder, lambda new: settled_ranges(new, range_bytes))


def frames(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """``(log_id, seq, ts_us, msg_id, payload, size)`` of every frame; ``seq`` is its byte offset,
    ``size`` what it occupies with its stamp, checksum and signature."""
    return settled_ranges(files, range_bytes).mapInArrow(_frames, FRAMES)


def framed_bytes(framed: DataFrame) -> DataFrame:
    return framed.groupBy("log_id").agg(F.sum("size").cast("long").alias("bytes"))


def _definitions(dialect: DataFrame) -> dict[int, tuple[str, np.dtype, list[tuple[str, bool]]]]:
    """Per message id: name, payload layout, and its kept fields (is it text?).

    A dialect is a protocol definition, as long as the protocol has fields.
    """
    rows = layered_dialect(dialect).collect()
    by_id: dict[int, list] = {}
    for r in rows:
        by_id.setdefault(r["msg_id"], []).append(r)
    out = {}
    for msg_id, fields in by_id.items():
        full = max(f["offset"] + f["size"] * max(1, f["array_len"]) for f in fields)
        names, layouts, offsets, kept = [], [], [], []
        for f in sorted(fields, key=lambda f: f["offset"]):
            scalar, many = SCALARS.get(f["type"].removesuffix("[]")), f["array_len"] > 0
            text = scalar == "S1"
            if scalar is None or (many and not text):
                continue  # arrays of numbers have no place in a table of scalars
            names.append(f["field"])
            layouts.append(f"S{f['array_len']}" if many else scalar)
            offsets.append(f["offset"])
            kept.append((f["field"], text))
        layout = np.dtype({"names": names, "formats": layouts, "offsets": offsets, "itemsize": full})
        out[msg_id] = (fields[0]["msg_name"], layout, kept)
    return out


def read_tlog(files: DataFrame, dialect: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Records of telemetry logs; messages the dialect does not define are left out."""
    defined = _definitions(dialect)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            raw = np.frombuffer(run.buf, dtype=np.uint8)
            for msg_id in np.unique(run.frames[:, 1]).tolist():
                if msg_id not in defined:
                    continue
                name, layout, kept = defined[msg_id]
                of_type = np.flatnonzero(run.frames[:, 1] == msg_id)
                for cut in range(0, len(of_type), ROWS_PER_BATCH):
                    rows = of_type[cut : cut + ROWS_PER_BATCH]
                    part = run.frames[rows]
                    n, span = len(part), np.arange(layout.itemsize)
                    # A payload may stop short of its last fields: they read as 0.
                    at = np.minimum(part[:, 2:3] + span, len(raw) - 1)
                    body = np.where(span < part[:, 3:4], raw[at], 0).astype(np.uint8)
                    values = np.ascontiguousarray(body).view(layout).reshape(n)
                    numbers = [(f, known_numbers(values[f].astype(np.float64))) for f, text in kept if not text]
                    texts = [
                        (f, pa.array([_text(v) for v in values[f].tolist()], pa.string())) for f, text in kept if text
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            run.logs.take(pa.array(rows)), pa.array(["tlog"] * n, pa.string()),
                            pa.array(part[:, 0] + run.bases[rows], pa.int64()), pa.array([msg_id] * n, pa.int32()),
                            pa.array([name] * n, pa.string()), run.stamps(part),
                            map_column([f for f, _ in numbers], [v for _, v in numbers], n, pa.float64()),
                            map_column([f for f, _ in texts], [v for _, v in texts], n, pa.string()),
                        ],
                        names=["log_id", "source", "seq", "msg_type", "message", "ts_us", "nums", "txts"],
                    )

    return settled_ranges(files, range_bytes).mapInArrow(decode, RECORDS).withColumn("has_time", F.lit(True))
