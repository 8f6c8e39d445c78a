"""Self-describing onboard logs: records of declared layout behind a two-byte mark.

A record is ``A3 95 type body``.  Type 128 declares the layout of another type;
a type may not be read before its declaration.  Frames are found by a short
loop over bytes; bodies are decoded a whole type at a time with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.sources.files import byte_ranges, indexed, is_index, range_bytes_of, settle_ranges, settled, told_batches

# The record mark and the type that declares others.
MARK = b"\xa3\x95"
DECLARATION = 128
DECLARATION_SIZE = 86  # type, length, name[4], format[16], columns[64]

# Format characters, their numpy layout and scale (text has none).
LAYOUT = {
    "a": ("(32,)<i2", None),
    "b": ("i1", 1.0),
    "B": ("u1", 1.0),
    "h": ("<i2", 1.0),
    "H": ("<u2", 1.0),
    "i": ("<i4", 1.0),
    "I": ("<u4", 1.0),
    "f": ("<f4", 1.0),
    "d": ("<f8", 1.0),
    "n": ("S4", None),
    "N": ("S16", None),
    "Z": ("S64", None),
    "c": ("<i2", 0.01),
    "C": ("<u2", 0.01),
    "e": ("<i4", 0.01),
    "E": ("<u4", 0.01),
    "L": ("<i4", 1e-7),
    "M": ("u1", 1.0),
    "q": ("<i8", 1.0),
    "Q": ("<u8", 1.0),
}

ROWS_PER_BATCH = 20_000
#: Marks followed at a time while types are being declared, and at most.
FEW_MARKS, MANY_MARKS = 256, 1 << 17

FRAMES = "log_id string, seq long, msg_type int, body binary"
RECORDS = (
    "log_id string, source string, seq long, msg_type int, message string, ts_us long, has_time boolean, "
    "nums map<string,double>, txts map<string,string>, shadowed boolean"
)


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


class Layout:
    """How one declared type is laid out."""

    def __init__(self, declaration: bytes):
        self.msg_type = declaration[0]
        self.name = _text(declaration[2:6]).strip()
        self.format = _text(declaration[6:22])
        self.labels = [c.strip() for c in _text(declaration[22:86]).split(",") if c.strip()]
        known = bool(self.format) and all(c in LAYOUT for c in self.format)
        self.dtype = np.dtype([(f"c{i}", LAYOUT[c][0]) for i, c in enumerate(self.format)]) if known else None

    def columns(self) -> dict[str, int]:
        """Label to column; a repeated label reads its last column."""
        named = [self.labels[i] if i < len(self.labels) else f"f{i}" for i in range(len(self.format))]
        return {label: i for i, label in enumerate(named)}


    def has_clock(self) -> bool:
        at = self.columns().get("TimeUS")
        return at is not None and LAYOUT[self.format[at]][1] is not None


def _layouts(declared: bytes) -> dict[int, Layout]:
    out: dict[int, Layout] = {}
    for at in range(0, len(declared), DECLARATION_SIZE):
        layout = Layout(declared[at : at + DECLARATION_SIZE])
        if layout.dtype is not None and layout.msg_type != DECLARATION:
            out.setdefault(layout.msg_type, layout)
    return out


def _scan(row: dict) -> tuple[dict[int, np.ndarray], dict[int, Layout], bytes, int, int, bytes]:
    """Record positions per type in one byte range, with what it declared and where it ended.

    Where the record behind a mark leads is worked out for many marks at once, so that
    following them is all that is done one by one.  A declaration changes that, so few
    marks are looked at ahead while types are being declared.
    """
    base = row["start"]
    buf = range_bytes_of(row)
    layouts = _layouts(row["known"] or b"")
    sizes = np.full(256, -1, np.int64)
    sizes[DECLARATION] = DECLARATION_SIZE
    for t, layout in layouts.items():
        sizes[t] = layout.dtype.itemsize
    stop = min(row["hi"] - base, len(buf) - 2)
    raw = np.frombuffer(buf, np.uint8)
    marks = np.flatnonzero((raw[:-2] == MARK[0]) & (raw[1:-1] == MARK[1])) if len(raw) > 2 else np.empty(0, np.int64)
    marks = marks[marks < stop]
    kinds = raw[marks + 2]
    taken: list[np.ndarray] = []
    declared: list[bytes] = []
    at, reach, cut, after = 0, FEW_MARKS, False, 0
    while at < len(marks) and not cut:
        # With what is declared so far: where the record behind each of the next marks ends.
        upto = min(len(marks), at + reach)
        kind = kinds[at:upto]
        size = sizes[kind]
        ends = marks[at:upto] + 3 + size
        whole = (size >= 0) & (ends <= len(buf))
        short = (size >= 0) & ~whole
        leads = (np.where(whole, np.searchsorted(marks, ends), np.arange(at + 1, upto + 1)) - at).tolist()
        stops = (short | (kind == DECLARATION)).tolist()
        i, here = 0, []
        while i < len(leads):
            here.append(i)
            if stops[i]:
                break
            i = leads[i]
        visited = np.array(here, np.int64)
        met = visited[whole[visited]]
        taken.append(at + met)
        if len(met):
            after = int(ends[met[-1]])
        if i >= len(leads):
            at, reach = at + i, min(8 * reach, MANY_MARKS)
            continue
        # Only the end of the file can cut a record short; a declaration may change what follows.
        cut = bool(short[i])
        if not cut:
            body = buf[marks[at + i] + 3 : marks[at + i] + 3 + DECLARATION_SIZE]
            layout = Layout(body)
            if layout.dtype is not None and layout.msg_type not in layouts and layout.msg_type != DECLARATION:
                layouts[layout.msg_type] = layout
                sizes[layout.msg_type] = layout.dtype.itemsize
                declared.append(body)
            at, reach = at + leads[i], FEW_MARKS
    rows = np.concatenate(taken) if taken else np.empty(0, np.int64)
    positions, of = marks[rows], kinds[rows]
    found = {int(kind): positions[of == kind] for kind in np.unique(of)}
    return found, layouts, buf, base, max(row["hi"], base + after) if found else row["hi"], b"".join(declared)


def _last_clock(found: dict[int, np.ndarray], layouts: dict[int, Layout], buf: bytes) -> int | None:
    """The last stamp in a range: that of the last record whose type has a clock."""
    timed = [
        (at[-1], layouts[kind]) for kind, at in found.items() if kind != DECLARATION and layouts[kind].has_clock()
    ]
    for pos, layout in sorted(timed, key=lambda t: -t[0]):
        clock, _, _ = _decode(layout, _gather(buf, np.array([pos + 3]), layout.dtype.itemsize))
        if clock[0].as_py() is not None:
            return clock[0].as_py()
    return None


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return told_batches(_told(row) for batch in batches for row in batch.to_pylist())


def _told(row: dict) -> dict:
    found, layouts, buf, base, end, declared = _scan(row)
    last = max((int(p[-1]) for p in found.values()), default=None)
    if last is None or base + last < row["lo"]:
        end = row["hi"]
    first = np.sort(np.concatenate([*found.values(), np.empty(0, np.int64)])) + base
    early = first[first < row["lo"] + 8192].tolist()
    clock = _last_clock(found, layouts, buf)
    seen = [
        {"type": kind, "name": layouts[kind].name, "first": base + int(at[0])}
        for kind, at in found.items() if kind != DECLARATION
    ]
    return {**row, "end": end, "declared": declared, "early": early, "last_clock": clock, "seen": seen}


def _gather(buf: bytes, at: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``size`` bytes starting at the given positions."""
    return np.frombuffer(buf, dtype=np.uint8)[at[:, None] + np.arange(size)]


def map_column(labels: list[str], values: list[pa.Array], n: int, kind: pa.DataType) -> pa.Array:
    """A map column with the same keys in every row."""
    width = len(labels)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    keys = pa.array(labels * n, pa.string())
    if not width:
        return pa.MapArray.from_arrays(offsets, keys, pa.array([], kind))
    order = pa.array((np.arange(n)[:, None] + np.arange(width)[None, :] * n).ravel())
    return pa.MapArray.from_arrays(offsets, keys, pa.concat_arrays(values).take(order))


def known_numbers(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~np.isfinite(values))


def _decode(layout: Layout, rows: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Time, numbers and texts of the bodies of one type."""
    n = len(rows)
    body = np.ascontiguousarray(rows).view(layout.dtype).reshape(n)
    number_names, numbers, text_names, texts = [], [], [], []
    time = pa.nulls(n, pa.int64())
    for label, i in layout.columns().items():
        raw, scale = body[f"c{i}"], LAYOUT[layout.format[i]][1]
        if scale is None:
            text_names.append(label)
            said = [" ".join(map(str, r)) for r in raw] if layout.format[i] == "a" else [_text(r) for r in raw.tolist()]
            texts.append(pa.array(said, pa.string()))
            continue
        value = raw.astype(np.float64)
        if scale != 1.0:
            value = value * scale
        number_names.append(label)
        numbers.append(known_numbers(value))
        if label == "TimeUS":
            whole = raw.astype(np.int64) if raw.dtype.kind in "iu" and scale == 1.0 else np.nan_to_num(value).astype(np.int64)
            time = pa.array(whole, pa.int64(), mask=~np.isfinite(value))
    return (
        time,
        map_column(number_names, numbers, n, pa.float64()),
        map_column(text_names, texts, n, pa.string()),
    )


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found, layouts, buf, base, _, _ = _scan(row)
            for kind, at in found.items():
                size = DECLARATION_SIZE if kind == DECLARATION else layouts[kind].dtype.itemsize
                for cut in range(0, len(at), ROWS_PER_BATCH):
                    part = at[cut : cut + ROWS_PER_BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["log_id"]] * len(part), pa.string()),
                            pa.array(part + base, pa.int64()),
                            pa.array([kind] * len(part), pa.int32()),
                            pa.array([buf[p + 3 : p + 3 + size] for p in part.tolist()], pa.binary()),
                        ],
                        names=["log_id", "seq", "msg_type", "body"],
                    )


def _fill(positions: np.ndarray, clocks: np.ndarray, known: np.ndarray, before: int) -> np.ndarray:
    """Stamps in file order, a row without one taking the last seen before it."""
    order = np.argsort(positions, kind="stable")
    index = np.where(known[order], np.arange(len(order)), -1)
    last = np.maximum.accumulate(index)
    filled = np.where(last >= 0, clocks[order][last], before)
    out = np.empty_like(filled)
    out[order] = filled
    return out


def _hidden(row: dict, parts: list[tuple]) -> set[int]:
    """Types that a later one of the same name replaces; told by the range, or here where it is the whole log."""
    if row["lo"] > 0 or row["hi"] < row["length"]:
        return set(row["hidden"] or ())
    first: dict[int, int] = {}
    names: dict[str, set[int]] = {}
    for layout, where, *_ in parts:
        first.setdefault(layout.msg_type, int(where[0]))
        names.setdefault(layout.name, set()).add(layout.msg_type)
    return {kind for kinds in names.values() for kind in kinds if kind != max(kinds, key=first.get)}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found, layouts, buf, base, _, _ = _scan(row)
            parts = []
            for kind, at in found.items():
                if kind == DECLARATION:
                    continue
                layout = layouts[kind]
                for cut in range(0, len(at), ROWS_PER_BATCH):
                    where = at[cut : cut + ROWS_PER_BATCH]
                    parts.append((layout, where, *_decode(layout, _gather(buf, where + 3, layout.dtype.itemsize))))
            if not parts:
                continue
            hidden = _hidden(row, parts)
            known = np.concatenate([p[2].is_valid().to_numpy(zero_copy_only=False) for p in parts])
            clocks = np.concatenate([p[2].fill_null(0).to_numpy(zero_copy_only=False) for p in parts])
            filled = _fill(np.concatenate([p[1] for p in parts]), clocks, known, row["clock"] or 0)
            done = 0
            for layout, where, _, nums, txts in parts:
                n = len(where)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["log_id"]] * n, pa.string()), pa.array(["bin"] * n, pa.string()),
                        pa.array(where + base, pa.int64()), pa.array([layout.msg_type] * n, pa.int32()),
                        pa.array([layout.name] * n, pa.string()), pa.array(filled[done : done + n], pa.int64()),
                        pa.array(known[done : done + n], pa.bool_()), nums, txts,
                        pa.array([layout.msg_type in hidden] * n, pa.bool_()),
                    ],
                    names=["log_id", "source", "seq", "msg_type", "message", "ts_us", "has_time", "nums", "txts", "shadowed"],
                )
                done += n


def settled_ranges(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Ranges to read, of files or of a stored index (``index``)."""
    return settled(files) if is_index(files) else settle_ranges(byte_ranges(files, range_bytes), _summarise)


def index(files: DataFrame, folder: str, range_bytes: int | None = None) -> DataFrame:
    """Files as ranges that need no framing again; new or grown ones are framed and added to ``folder``."""
    return indexed(files, folder, lambda new: settled_ranges(new, range_bytes))


def frames(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """``(log_id, seq, msg_type, body)`` of every record; ``seq`` is its byte offset."""
    return settled_ranges(files, range_bytes).mapInArrow(_frames, FRAMES)


def framed_bytes(framed: DataFrame) -> DataFrame:
    return framed.groupBy("log_id").agg(F.sum(F.octet_length("body") + 3).cast("long").alias("bytes"))


def formats(framed: DataFrame) -> DataFrame:
    """Declared layouts, the first declaration of a type winning."""
    text = lambda at, size: F.regexp_replace(
        F.decode(F.substring("body", at, size), "ISO-8859-1"), r"(?s)\x00.*$", ""
    )
    declared = framed.where(F.col("msg_type") == DECLARATION).select(
        "log_id", "seq",
        F.conv(F.hex(F.substring("body", 1, 1)), 16, 10).cast("int").alias("msg_type"),
        F.trim(text(3, 4)).alias("name"),
        text(7, 16).alias("format"),
        F.filter(F.transform(F.split(text(23, 64), ","), lambda c: F.trim(c)), lambda c: c != "").alias("labels"),
    )
    usable = F.col("format").rlike("^[" + "".join(LAYOUT) + "]+$") & (F.col("msg_type") != DECLARATION)
    size = F.lit(0)
    for char, (layout, _) in LAYOUT.items():
        width = np.dtype(layout).itemsize
        size = size + F.length(F.regexp_replace("format", f"[^{char}]", "")) * width
    first = declared.where(usable).groupBy("log_id", "msg_type").agg(
        F.min_by(F.struct("name", "format", "labels", "seq"), F.col("seq")).alias("d")
    )
    return first.select(
        "log_id", "msg_type", "d.name", "d.format", "d.labels", F.col("d.seq").alias("declared_seq")
    ).withColumn("body_size", size)


def one_type_per_name(records: DataFrame) -> DataFrame:
    """Of several types sharing a name in one log, the one that appears last."""
    types = records.groupBy("log_id", "message", "msg_type").agg(F.min("seq").alias("first"))
    kept = types.groupBy("log_id", "message").agg(
        F.max_by("msg_type", "first").alias("keep"), F.count(F.lit(1)).alias("n")
    )
    shadowed = types.join(kept.where("n > 1"), ["log_id", "message"]).where("msg_type <> keep")
    return records.join(shadowed.select("log_id", "message", "msg_type"), ["log_id", "message", "msg_type"], "left_anti")


def read_dataflash(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """Records of onboard logs, a clock on every row; one pass, no shuffle.

    A row without a clock of its own takes the last one before it in the file, 0
    if there is none, and says so in ``has_time``.  Rows of a type that a later one of
    the same name replaces in its log are ``shadowed``: no series is built of them.
    """
    return settled_ranges(files, range_bytes).mapInArrow(_records, RECORDS)
