"""Building blocks that keep one very large log from landing in one task.

Most questions asked of a log need its rows in time order.  A plain window
partitioned by series does that with one shuffle, and it is what runs as long as
every series fits comfortably in a task.  When a series does not, the rows are
range-partitioned by ``(series, order)`` so that a long series spans several
pieces, the window runs per piece, and what one piece must know about the others
(the last row, a running total ...) travels in a carry table that holds at most
two rows per piece.  Pieces grow with the rows once there are ``MOST_PIECES`` of them,
and where there are more than ``BLOCK`` their summaries are folded in two levels, pieces
into blocks and blocks into the series, so that no task folds all pieces of a series.

Piece numbers come from a range partitioning that Spark samples at run time, so
they are written to the shared scratch folder before anything is derived from
them: a lost executor then re-reads the same numbers instead of sampling anew.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of one series (or one group) a single task is asked to hold.
GROUP_ROWS = 1_000_000
#: Pieces that rows are cut into at most; more rows make longer pieces, which a task sorts on disk.
MOST_PIECES = 100_000
#: Pieces whose summaries one task folds.
BLOCK = 1_000

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without; there a temporary folder is made once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="flightlake-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below this application's scratch folder."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back, cutting its lineage.

    Tables lie in one folder per application, to be removed when it is done.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_bound: ContextVar[int | None] = ContextVar("rows a group holds at most", default=None)


@contextmanager
def groups_hold_at_most(rows: int | None) -> Iterator[None]:
    """What is known of the sizes of groups, so that they are not counted inside.

    ``rows`` bounds the groups of everything built within, as a catalog can tell; None
    takes back what was known.  A bound beyond ``GROUP_ROWS`` says nothing: then groups
    are counted as usual.
    """
    before = _bound.set(rows)
    try:
        yield
    finally:
        _bound.reset(before)


def known_small(limit: int | None = None) -> bool:
    bound = _bound.get()
    return bound is not None and bound <= (limit or GROUP_ROWS)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in the largest group and in total; pre-aggregated before the shuffle."""
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("largest"), F.sum("n").alias("total"))
        .first()
    )
    return int(row["largest"] or 0), int(row["total"] or 0)


@dataclass(frozen=True)
class Scan:
    """One ordered computation, with its per-piece summary and how to carry it on.

    ``fold`` makes one summary of those of several pieces in order; ``merge`` joins what
    is known near a row with what is carried from afar.
    """

    local: Callable[[WindowSpec, WindowSpec, WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec, WindowSpec, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]
    fold: Callable[[Column, Column], Column]


def _last_of(s: Column, place: Column) -> Column:
    return F.max_by(s, F.when(s.isNotNull(), place))


def _first_of(s: Column, place: Column) -> Column:
    return F.min_by(s, F.when(s.isNotNull(), place))


def _before(w: WindowSpec, inclusive: bool) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def previous(*cols: str) -> Scan:
    """The given columns of the row just before, as a struct."""
    row = F.struct(*cols)
    return Scan(
        lambda fwd, back, whole: F.lag(row).over(fwd),
        lambda pos: F.max_by(row, pos),
        lambda s, fwd, back, whole: F.lag(s).over(fwd),
        lambda here, carried: F.coalesce(here, carried),
        F.max_by,
    )


def following(*cols: str) -> Scan:
    """The given columns of the row just after, as a struct."""
    row = F.struct(*cols)
    return Scan(
        lambda fwd, back, whole: F.lead(row).over(fwd),
        lambda pos: F.min_by(row, pos),
        lambda s, fwd, back, whole: F.lead(s).over(fwd),
        lambda here, carried: F.coalesce(here, carried),
        F.min_by,
    )


def last_known(value: Column) -> Scan:
    """Latest non-null ``value`` at or before the row."""
    return Scan(
        lambda fwd, back, whole: F.last(value, True).over(_before(fwd, True)),
        lambda pos: F.max_by(value, F.when(value.isNotNull(), pos)),
        lambda s, fwd, back, whole: F.last(s, True).over(_before(fwd, False)),
        lambda here, carried: F.coalesce(here, carried),
        _last_of,
    )


def known_before(value: Column) -> Scan:
    """Latest non-null ``value`` strictly before the row."""
    at = last_known(value)
    return Scan(
        lambda fwd, back, whole: F.last(value, True).over(_before(fwd, False)), at.summary, at.carry, at.merge, at.fold
    )


def first_known(value: Column) -> Scan:
    """Earliest non-null ``value`` at or before the row."""
    return Scan(
        lambda fwd, back, whole: F.first(value, True).over(_before(fwd, True)),
        lambda pos: F.min_by(value, F.when(value.isNotNull(), pos)),
        lambda s, fwd, back, whole: F.first(s, True).over(_before(fwd, False)),
        lambda here, carried: F.coalesce(carried, here),
        _first_of,
    )


def next_known(value: Column) -> Scan:
    """Earliest non-null ``value`` at or after the row.

    Runs on the reversed order: a frame that reaches to the end of the partition
    would be re-evaluated for every row.
    """
    return Scan(
        lambda fwd, back, whole: F.last(value, True).over(_before(back, True)),
        lambda pos: F.min_by(value, F.when(value.isNotNull(), pos)),
        lambda s, fwd, back, whole: F.last(s, True).over(_before(back, False)),
        lambda here, carried: F.coalesce(here, carried),
        _first_of,
    )


def running_sum(value: Column) -> Scan:
    """Sum of ``value`` up to and including the row."""
    return Scan(
        lambda fwd, back, whole: F.sum(value).over(_before(fwd, True)),
        lambda pos: F.sum(value),
        lambda s, fwd, back, whole: F.sum(s).over(_before(fwd, False)),
        lambda here, carried: F.when(
            here.isNotNull() | carried.isNotNull(),
            F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)),
        ),
        lambda s, place: F.sum(s),
    )


def row_index() -> Scan:
    """Position of the row in its series, counted from 0."""
    one = F.lit(1).cast("long")
    return Scan(
        lambda fwd, back, whole: F.sum(one).over(_before(fwd, True)) - 1,
        lambda pos: F.sum(one),
        lambda s, fwd, back, whole: F.sum(s).over(_before(fwd, False)),
        lambda here, carried: F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)),
        lambda s, place: F.sum(s),
    )


def total(value: Column, how: str = "sum") -> Scan:
    """``sum``, ``min``, ``max`` or ``count`` of ``value`` over the whole series."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how]
    again = F.sum if how == "count" else fold
    return Scan(
        lambda fwd, back, whole: fold(value).over(whole),
        lambda pos: fold(value),
        lambda s, fwd, back, whole: again(s).over(whole),
        lambda here, carried: F.coalesce(carried, here),
        lambda s, place: again(s),
    )


class Ordered:
    """Rows grouped by ``keys`` and ordered by ``order`` within each group.

    ``order`` must be unique within a group (logs use ``ts_us, seq``).
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        split: bool | None = None,
        group_rows: int | None = None,
        _ready: bool = False,
        _pieces: int = 1,
    ):
        self.keys, self.order = list(keys), list(order)
        self._written, self._pieces = False, _pieces
        limit = group_rows or GROUP_ROWS
        if not _ready:
            rows = 0
            if split is None and known_small(limit):
                split = False
            if split is None or split:
                largest, rows = group_sizes(df, self.keys)
                split = split or largest > limit
            if split:
                df, self._pieces = self._cut(df, rows, limit)
                self._written = True
        self.split = bool(split)
        self.df = df

    def _cut(self, df: DataFrame, rows: int, limit: int) -> tuple[DataFrame, int]:
        """Rows written with the piece each belongs to, and how many pieces were meant.

        Tasks follow what a task can hold.  Pieces meant to be shorter than that are cut
        inside a sorted task, so they cost neither a task nor a file, nor rows of the
        sample that range partitioning sends to the driver.
        """
        shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = max(shuffles, min(MOST_PIECES, 2 * math.ceil(rows / limit)))
        tasks = max(shuffles, min(pieces, 2 * math.ceil(rows / max(limit, GROUP_ROWS))))
        each = pieces // tasks
        tasks = pieces // each
        ranged = df.repartitionByRange(tasks, *self.keys, *self.order)
        number = F.spark_partition_id()
        if each > 1:
            ranged = ranged.sortWithinPartitions(*self.keys, *self.order)
            length = math.ceil(rows / (tasks * each))
            # The low bits count a task's rows.  Numbers are left for tasks that got more than meant.
            place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            spare = 4 * each
            within = F.least(F.floor(place / length), F.lit(spare - 1))
            number = (number * spare + within).cast("long")
        return scratch_table(ranged.withColumn("_piece", number), "pieces"), tasks * each

    def _same(self, df: DataFrame) -> Ordered:
        return Ordered(df, self.keys, self.order, split=self.split, _ready=True, _pieces=self._pieces)

    def with_columns(self, **cols: Column) -> Ordered:
        return self._same(self.df.withColumns(cols))

    def where(self, condition: Column) -> Ordered:
        return self._same(self.df.where(condition))

    def scan(self, **scans: Scan) -> Ordered:
        """Add one column per scan; all of them share one shuffle and sort.

        A split series is read twice, for its carries and for its rows, so what
        was computed before is written down first.
        """
        if self.split and not self._written:
            return self.frozen("scan").scan(**scans)
        part = self.keys + (["_piece"] if self.split else [])
        whole = Window.partitionBy(*part)
        fwd = whole.orderBy(*self.order)
        back = whole.orderBy(*[F.col(c).desc() for c in self.order])
        out = self.df.select(
            "*", *[s.local(fwd, back, whole).alias(name) for name, s in scans.items()]
        )
        if not self.split:
            return self._same(out)

        carries = self._carries(part, scans)
        kept = self.df.columns
        return self._same(
            out.join(carries, part, "left").select(
                *kept,
                *[
                    s.merge(F.col(name), F.col(f"_c_{name}")).alias(name)
                    for name, s in scans.items()
                ],
            )
        )

    def _carries(self, part: list[str], scans: dict[str, Scan]) -> DataFrame:
        """What every piece of a series that crosses a border must know of the other pieces.

        No more than two rows per piece, however many series there are.  Spark
        broadcasts them while they are few, and else joins by piece.
        """
        position = F.struct(*self.order)
        held = self.df.groupBy(*part).agg(*[s.summary(position).alias(f"_s_{name}") for name, s in scans.items()])
        over_key = Window.partitionBy(*self.keys)

        def carried(over: WindowSpec, by: str, mark: str) -> list[Column]:
            forward, backward = over.orderBy(by), over.orderBy(F.desc(by))
            return [s.carry(F.col(f"_s_{name}"), forward, backward, over).alias(f"{mark}{name}") for name, s in scans.items()]

        if self._pieces <= BLOCK:
            crossing = held.withColumn("_n", F.count(F.lit(1)).over(over_key)).where("_n > 1")
            return crossing.select(*part, *carried(over_key, "_piece", "_c_"))
        held = scratch_table(held.withColumn("_block", F.floor(F.col("_piece") / BLOCK)), "summaries")
        blocks = held.groupBy(*self.keys, "_block").agg(
            F.count(F.lit(1)).alias("_n"), *[s.fold(F.col(f"_s_{name}"), F.col("_piece")).alias(f"_s_{name}") for name, s in scans.items()]
        )
        crossing = blocks.withColumn("_n", F.sum("_n").over(over_key)).where("_n > 1")
        far = crossing.select(*self.keys, "_block", *carried(over_key, "_block", "_f_"))
        over_block = Window.partitionBy(*self.keys, "_block")
        near = held.select(*part, "_block", *carried(over_block, "_piece", "_n_"))
        return near.join(far, [*self.keys, "_block"]).select(
            *part, *[s.merge(F.col(f"_n_{name}"), F.col(f"_f_{name}")).alias(f"_c_{name}") for name, s in scans.items()]
        )

    def frozen(self, name: str) -> Ordered:
        """Written to scratch, for steps that read the rows several times."""
        out = self._same(scratch_table(self.df, name))
        out._written = True
        return out

    def attach(self, per_key: DataFrame, how: str = "inner") -> Ordered:
        """Join a table with one row per key.

        A split series is joined on ``(key, piece)``, with the per-key row
        repeated once per piece, so no key is gathered into one task.
        """
        if not self.split:
            return self._same(self.df.join(per_key, self.keys, how))
        part = [*self.keys, "_piece"]
        spread = self.df.select(*part).distinct().join(per_key, self.keys)
        return self._same(self.df.join(spread, part, how))

    def rows(self) -> DataFrame:
        return self.df.drop("_piece")


class Groups:
    """Which groups of a table are too large for one task; looked up once, used often."""

    def __init__(self, df: DataFrame, keys: Sequence[str], group_rows: int | None = None):
        self.keys = list(keys)
        limit = group_rows or GROUP_ROWS
        self.hot: DataFrame | None = None
        if known_small(limit):
            return
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        hot = sizes.select(*self.keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
        #: Large groups and the parts each is cut into.
        self.hot = None if hot.limit(1).count() == 0 else scratch_table(hot, "hot")

    @property
    def split(self) -> bool:
        return self.hot is not None

    def join(self, df: DataFrame, per_key: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
        """Join a one-row-per-key table to many rows per key.

        Spark broadcasts the small side when its size allows.  A large group is
        salted by a hash of ``spread_by``, its one row repeated per salt.
        """
        if self.hot is None:
            return df.join(per_key, self.keys, how)
        salts = F.coalesce(F.col("_salts"), F.lit(1))
        hot = self.hot  # written, so Spark knows its size and broadcasts it if small
        left = df.join(hot, self.keys, "left").withColumn(
            "_salt", F.pmod(F.xxhash64(spread_by), salts.cast("long")).cast("int")
        )
        right = (
            per_key.join(hot, self.keys, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            .drop("_salts")
        )
        return left.join(right, [*self.keys, "_salt"], how).drop("_salt", "_salts")


def join_per_key(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread_by: str, how: str = "inner"
) -> DataFrame:
    """``Groups.join`` where the groups are needed only once."""
    return Groups(df, keys).join(df, per_key, spread_by, how)


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", split: bool | None = None
) -> DataFrame:
    """Median of the non-null values per key, mean of the two middles when even.

    Spark's ``median`` keeps a group's distinct values in one buffer, which is
    right up to ``GROUP_ROWS``.  Beyond, values are counted first and the middle
    is found from running counts over range-partitioned distinct values.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    if split is None:
        split = not known_small() and group_sizes(known, keys)[0] > GROUP_ROWS
    if not split:
        return known.groupBy(*keys).agg(F.median(value).alias(name))
    counted = known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = (
        Ordered(counted, keys, ["_v"], split=True)
        .scan(_upto=running_sum(F.col("_n")), _all=total(F.col("_n")))
        .rows()
    )
    lower, upper = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    first = F.col("_upto") - F.col("_n")
    holds = lambda at: (first <= at) & (at < F.col("_upto"))
    return ranked.groupBy(*keys).agg(
        (
            (F.max(F.when(holds(lower), F.col("_v"))) + F.max(F.when(holds(upper), F.col("_v")))) / 2
        ).alias(name)
    )


def explode_range(df: DataFrame, count: Column, name: str, block: int = 65_536) -> DataFrame:
    """One row per integer in ``[0, count)``, in blocks so no row expands without bound.

    The blocks are spread over an explicit number of partitions: they weigh next
    to nothing until they are expanded, and would otherwise be merged into one.
    """
    blocks = df.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / block)))
    )
    spread = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    start = F.col("_block") * block
    stop = F.least(start + block, count.cast("long")) - 1
    return spread.withColumn(name, F.explode(F.sequence(start, stop))).drop("_block")
