"""Finding logs, and cutting large ones into byte ranges that tasks can share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlake.scale import scratch_table

#: Bytes one task reads at a time; a larger log is shared by several tasks.
RANGE_BYTES = 32 << 20
#: A range also reads this far past its end, to finish its last record.
OVERHANG = 4096
#: Bytes a task reads at least, where there are enough tasks: short logs share one.
TASK_BYTES = 8 << 20
#: Ranges told of in one batch.
TOLD_ROWS = 256
#: Tasks a reading job is cut into at most.
MOST_TASKS = 200_000

#: Bytes of one declaration, and the columns of a stored frame index.
DECLARED_BYTES = 86
INDEX = "log_id string, path string, lo long, hi long, length long, start long, known binary, clock long, hidden array<int>"

RANGES = (
    "log_id string, path string, lo long, hi long, length long, start long, known binary, content binary, clock long, "
    "hidden array<int>"
)
#: What a scan tells of a range; its bytes stay where they are.
TOLD = RANGES.replace("content binary, ", "") + ", end long, declared binary, early array<long>, last_clock long, seen array<struct<type:int,name:string,first:long>>"
TOLD_ARROW = pa.schema(
    [
        ("log_id", pa.string()), ("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()),
        ("length", pa.int64()), ("start", pa.int64()), ("known", pa.binary()),
        ("clock", pa.int64()), ("hidden", pa.list_(pa.int32())), ("end", pa.int64()), ("declared", pa.binary()), ("early", pa.list_(pa.int64())),
        ("last_clock", pa.int64()),
        ("seen", pa.list_(pa.struct([("type", pa.int32()), ("name", pa.string()), ("first", pa.int64())]))),
    ]
)


def log_kind(path: Column, first_byte: Column | None = None) -> Column:
    """``bin`` or ``tlog`` by extension, else by the first byte (0xA3 opens a bin)."""
    name = F.lower(path)
    by_name = F.when(name.endswith(".bin") | name.endswith(".log"), "bin").when(name.endswith(".tlog"), "tlog")
    if first_byte is None:
        return by_name
    return F.coalesce(by_name, F.when(F.hex(first_byte) == "A3", "bin").otherwise("tlog"))


def _peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first byte of every file whose name does not tell its kind."""
    for batch in batches:
        told = zip(batch.column("path").to_pylist(), batch.column("named").to_pylist(), strict=True)
        heads = [None if named else read_range(path, 0, 1) for path, named in told]
        yield batch.append_column("head", pa.array(heads, pa.binary()))


def with_kind(listed: DataFrame) -> DataFrame:
    """``(log_id, path, length, kind)`` of listed files ``(path, length)``, streamed or not.

    Only the listing is read; files without a telling extension are peeked at.
    """
    return (
        listed.select("path", "length", log_kind(F.col("path")).isNotNull().alias("named"))
        .mapInArrow(_peek, "path string, length long, named boolean, head binary")
        .select(
            F.col("path").alias("log_id"), "path", "length", log_kind(F.col("path"), F.col("head")).alias("kind")
        )
    )


def list_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``(log_id, path, length, kind)`` of every file below ``folder``."""
    return with_kind(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def read_range(path: str, start: int, stop: int) -> bytes:
    """Bytes ``[start, stop)`` of a file any executor can reach."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest.startswith("/"):
        # A local name may hold anything, spaces and percent signs too.
        local = rest if scheme == "file" else path
        store, inner = fs.LocalFileSystem(), "/" + local.lstrip("/") if local.startswith("/") else local
    else:
        # Names come as they are, and a URI has them quoted.
        store, inner = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/@"))
    with store.open_input_file(inner) as f:
        f.seek(start)
        return f.read(max(0, stop - start))


def range_bytes_of(row: dict) -> bytes:
    """Bytes of one range from its current start, with the overhang."""
    stop = min(row["hi"] + OVERHANG, row["length"])
    if row["content"] is not None:
        return row["content"][row["start"] - row["lo"] : stop - row["lo"]]
    return read_range(row["path"], row["start"], stop)


def byte_ranges(files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """One row per range of every file, each starting with nothing known.

    Files normally come as ``(log_id, path, length)`` and each task opens its
    own range.  Where executors cannot reach the paths, or the bytes are already
    in a table, a ``content`` column takes their place.
    """
    size = range_bytes or RANGE_BYTES
    n = F.floor((F.col("length") - 1) / size)
    lo, hi = F.col("r") * size, F.least((F.col("r") + 1) * size, F.col("length"))
    if "content" in files.columns:
        files = files.withColumn("length", F.octet_length("content").cast("long"))
        piece = F.substring(F.col("content"), (lo + 1).cast("int"), (hi - lo + OVERHANG).cast("int"))
        files = files.withColumn("path", F.lit(None).cast("string"))
    else:
        piece = F.lit(None).cast("binary")
        files = files.withColumn("content", piece)
    return (
        files.where("length > 0")
        .select("log_id", "path", "length", "content", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("r"))
        .select(
            "log_id", "path", lo.alias("lo"), hi.alias("hi"), "length",
            lo.alias("start"), F.unhex(F.lit("")).alias("known"), piece.alias("content"),
            F.lit(None).cast("long").alias("clock"), F.lit(None).cast("array<int>").alias("hidden"),
        )
    )


def _spread(ranges: DataFrame, tasks: int) -> DataFrame:
    """Ranges dealt out evenly.  The number is explicit: a row that stands for 32
    MiB weighs a few bytes, and left to its own sizing Spark would merge them all."""
    return ranges.repartition(max(1, min(tasks, MOST_TASKS)))


def _first_declared(scanned: DataFrame) -> DataFrame:
    """``(log_id, _declared)``: where each type of a log is first declared, and how.

    A minimum by log and type, merged on the way: what is gathered of a log are its types, at
    most 256 however many ranges it has.
    """
    n = F.floor(F.octet_length("declared") / DECLARED_BYTES).cast("int")
    body = F.substring(F.col("declared"), F.col("i") * DECLARED_BYTES + 1, F.lit(DECLARED_BYTES))
    each = scanned.where(n > 0).select("log_id", "lo", "declared", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    first = each.groupBy("log_id", F.substring(body, 1, 1).alias("type")).agg(
        F.min(F.struct("lo", "i", F.hex(body).alias("body"))).alias("d")
    )
    return first.groupBy("log_id").agg(F.sort_array(F.collect_list("d")).alias("_declared"))


def hidden_types(scanned: DataFrame) -> DataFrame:
    """``(log_id, hidden)``: types that another of the same name replaces in their log.

    Of several the one whose first record comes last stays.  Ranges each tell their first
    record of every type, so this is a minimum by log and type, whatever read which range.
    """
    each = scanned.select("log_id", F.inline("seen")).groupBy("log_id", "type", "name").agg(F.min("first").alias("first"))
    by_name = each.groupBy("log_id", "name").agg(
        F.max(F.struct("first", "type"))["type"].alias("kept"), F.collect_set("type").alias("types")
    )
    gone = by_name.where(F.size("types") > 1).select("log_id", F.explode(F.array_except("types", F.array("kept"))).alias("type"))
    return gone.groupBy("log_id").agg(F.sort_array(F.collect_list("type")).alias("hidden"))


def _known_before(lo: Column) -> Column:
    """What ranges before ``lo`` declare, in file order."""
    ahead = F.filter(F.coalesce("_declared", F.array().cast("array<struct<lo:bigint,i:int,body:string>>")), lambda d: d["lo"] < lo)
    return F.unhex(F.array_join(F.transform(ahead, lambda d: d["body"]), ""))


def told_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """What a scan tells of its ranges, many to a batch."""
    while part := list(islice(rows, TOLD_ROWS)):
        yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k != "content"} for r in part], schema=TOLD_ARROW)


def settle_ranges(
    ranges: DataFrame, summarise: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], declares: bool = True
) -> DataFrame:
    """Give every range the position and declarations a reader from byte 0 would have.

    A log has no index: where a record starts depends on everything before it.
    So all ranges are scanned at once from a guess (their first byte), each
    telling where it ended, what it declared, and where its first records were.
    A range whose true start - the end of the one before - was among those
    first records has already been read right; the others are scanned again.
    Every round settles at least one more range of each log, and as records
    fall into step within a few hundred bytes, two rounds are usual.  ``clock``
    is the last stamp any earlier range of the log carries.

    ``summarise`` adds ``end, declared, early, last_clock``; ``declares`` is False for
    logs that declare nothing.  Ranges are written down first, so what makes them runs
    once, and bytes that came with them are joined only to ranges that are to be read.
    """
    ranges = scratch_table(ranges, "ranges")
    inline = not ranges.where("content IS NOT NULL").isEmpty()
    count, furthest, size = ranges.agg(
        F.count(F.lit(1)), F.max("lo"), F.sum(F.col("hi") - F.col("lo"))
    ).first()
    shuffles = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(count, max(shuffles, math.ceil((size or 0) / TASK_BYTES)))
    if not furthest:
        return _spread(ranges, tasks)  # every log fits one range
    single = ranges.where("lo = 0 AND hi = length")
    shared = ranges.where("NOT (lo = 0 AND hi = length)")
    columns = [c.split()[0] for c in RANGES.split(", ")]

    def with_bytes(rows: DataFrame) -> DataFrame:
        if not inline:
            return rows.withColumn("content", F.lit(None).cast("binary")).select(*columns)
        return rows.join(shared.select("log_id", "lo", "content"), ["log_id", "lo"]).select(*columns)

    guessed = shared
    if declares:
        # What the heads declare is a good first guess for all ranges of a log.
        heads = shared.where("lo = 0").mapInArrow(summarise, TOLD).select("log_id", F.col("declared").alias("_head"))
        guessed = shared.join(heads, "log_id").withColumn(
            "known", F.when(F.col("lo") > 0, F.col("_head")).otherwise(F.col("known"))
        ).drop("_head")
    scanned = scratch_table(_spread(guessed, tasks).mapInArrow(summarise, TOLD), "ranges")
    while True:
        along = Window.partitionBy("log_id").orderBy("lo")
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        scanned_with = scanned.join(_first_declared(scanned), "log_id", "left") if declares else scanned
        due = scanned_with.withColumns(
            {
                "true_start": F.coalesce(F.greatest(F.lag("end").over(along), F.col("lo")), F.lit(0).cast("long")),
                "true_known": _known_before(F.col("lo")) if declares else F.col("known"),
                "clock": F.last("last_clock", True).over(earlier),
            }
        ).drop("_declared")
        same_known = F.col("known") == F.col("true_known")
        in_step = same_known & (
            (F.col("true_start") == F.col("start"))
            | (F.array_contains("early", F.col("true_start")) & (F.length("declared") == 0))
        )
        due = scratch_table(due.withColumn("settled", in_step), "ranges")
        moved = due.withColumns({"start": F.col("true_start"), "known": F.col("true_known")})
        if due.where(~F.col("settled")).limit(1).count() == 0:
            if declares:
                moved = moved.drop("hidden").join(hidden_types(moved), "log_id", "left")
            return _spread(single.unionByName(with_bytes(moved)), tasks)
        again = _spread(with_bytes(moved.where(~F.col("settled"))), tasks).mapInArrow(summarise, TOLD)
        kept = moved.where("settled").select(*scanned.columns)
        scanned = scratch_table(kept.unionByName(again), "ranges")


def settled(ranges: DataFrame) -> DataFrame:
    """Ranges of a stored index, ready to be read: no byte is looked at to find them."""
    count, size = ranges.agg(F.count(F.lit(1)), F.sum(F.col("hi") - F.col("lo"))).first()
    shuffles = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c.split()[0]) if c.split()[0] != "content" else F.lit(None).cast("binary").alias("content") for c in RANGES.split(", ")]
    return _spread(ranges.select(*columns), min(count, max(shuffles, math.ceil((size or 0) / TASK_BYTES))))


def is_index(files: DataFrame) -> bool:
    return {"lo", "hi", "start", "known", "clock"} <= set(files.columns)


def indexed(files: DataFrame, folder: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The settled ranges of ``files(log_id, path, length)``, kept in ``folder``.

    A log is framed once: ranges that the index holds for a log of the same length are
    taken from it, those of new or grown logs are settled and added.  Readers take the
    result in place of files.  A log added twice, by two runs at once, is read once.
    """
    spark = files.sparkSession
    spark.createDataFrame([], INDEX).write.mode("ignore").parquet(folder)
    wanted = files.select("log_id", "length")
    stored = spark.read.schema(INDEX).parquet(folder)
    new = files.join(stored.select("log_id", "length").distinct(), ["log_id", "length"], "left_anti")
    new = scratch_table(new, "unindexed")
    if not new.isEmpty():
        settle(new).select(*[c.split()[0] for c in INDEX.split(", ")]).write.mode("append").parquet(folder)
    stored = spark.read.schema(INDEX).parquet(folder)
    return stored.join(wanted, ["log_id", "length"], "left_semi").dropDuplicates(["log_id", "lo"])


def ingest_errors(files: DataFrame, framed: DataFrame) -> DataFrame:
    """``(log_id, reason)`` of logs that were not read whole.

    ``framed(log_id, bytes)`` is what each log's records occupy.  Bytes between
    records are skipped and a record cut short by the end is dropped; both are
    counted here rather than passed over.
    """
    size = F.octet_length("content").cast("long") if "content" in files.columns else F.col("length")
    read = F.coalesce("bytes", F.lit(0).cast("long"))
    return (
        files.select("log_id", size.alias("length"))
        .join(framed, "log_id", "left")
        .where(read < F.col("length"))
        .select(
            "log_id",
            F.when(read == 0, "no records").otherwise(
                F.concat((F.col("length") - read).cast("string"), F.lit(" bytes outside records"))
            ).alias("reason"),
        )
    )
