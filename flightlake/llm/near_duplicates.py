"""Near duplicates by an LSH forest: several sorted orders of one MinHash signature.

Texts with equal shingle sets are one *class* and take part once.  A class has a
signature of 64 MinHash values; each of 16 orders reads it from another place on.
In an order, classes that share a long enough prefix are candidates.  How long adapts
to the region: a prefix shared by more than ``REGION`` classes is read further, value
by value down a fixed ladder, until what shares it is few; so dense regions are cut
deep and thin ones stay shallow, and no region is ever enumerated whole.

A region the first prefix makes small is compared by that signature.  Denser ones are cut
to ``WIDE`` classes and compared by a longer signature, so that a text with a single
partner among thousands of less similar ones meets it too.  What more than ``WIDE`` classes
share a first prefix with is cut there; of those classes, the pairs that no cut has linked
are joined once more on the rarest shingles of their full sets, by which none is missed.

Candidates whose signatures agree enough are confirmed on the full shingle sets, in two
passes: first a tree of candidates in every region, which joins most of what belongs
together; an order adds only what the orders before it did not join.  Then every remaining
candidate pair whose ends are still in different components, once, in the first order it
meets in.  Pairs left out have both ends in one component already.

Defined results: null, empty or blank text has no shingle and links with nothing; a text
of fewer words than a shingle is one shingle; a repeated row is in its own class; rows
that share an id but not the text are one node of the link graph; a null id is linked
with nothing, its component is null and it is kept; the smallest id names a component, so
there are no ties; a text of any length is read whole; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm import words
from flightlake.llm.common import scratch_table, ship, small
from flightlake.llm.components import components

VALUES, ORDERS = 64, 16
#: Prefix lengths tried in turn, and classes that may share the first and a further one.
LADDER = (3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64)
REGION, WIDE = 32, 1024
#: How a class's region in an order is told, in four bits: 0 for none, a place on ``LADDER``
#: from 1, or this where the first prefix made it no larger than ``REGION``.
THIN = 15
#: Members of a dense region that a class meets which shares no further prefix with few.
SOME = 4
#: Values of the signature that is compared in dense regions.
LONG = 512
#: Standard errors of a signature's estimate below the threshold that a candidate may lie,
#: and above it from which on a candidate is linked without looking for a closer one.
SLACK, SURE = 4.0, 3.0
#: Rows of thin regions compared at a time, and pairs sent on at a time.
ROWS, PAIRS = 4096, 16_384
#: Members of either side of a shingle's group that are joined at a time.
BLOCK = 512
#: Narrow rows that the sets of a pair weigh like, where tasks are dealt by rows.
SET_WEIGHT = 50
#: Classes whose shingles tell which are common, and the buckets these are counted in.
COUNTED, BUCKETS = 4096, 1 << 16

_seeds = np.random.default_rng(20240607).integers(0, 2**32, (2, LONG), dtype=np.uint32)
_XOR, _TIMES = _seeds[0], _seeds[1] | np.uint32(1)
#: Prefix length by what tells a region.
_DEPTHS = np.array([0, *LADDER, 0, 0, 0, LADDER[0]], np.int64)

SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"


def least_estimate(threshold: float, values: int) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / values) ** 0.5


def _minima(values: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` MinHash values of every set of a row of sets, none empty."""
    short = (values.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(begin), n), np.uint32)
    for i in range(n):
        least[:, i] = np.minimum.reduceat((short ^ _XOR[i]) * _TIMES[i], begin)
    return least


def _shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, bounds = words.utf8(column)
    for a, b in words.portions(bounds):
        part = bounds[a : b + 1] - bounds[a]
        hashed, at = words.word_hashes(data[bounds[a] : bounds[b]], part)
        yield b - a, *words.distinct(*words.windows(hashed, at, k))


def _signatures(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, xors, signed = [], [], [], []
            for n, values, at in _shingle_sets(batch["text"], k):
                count = np.diff(at)
                full = np.flatnonzero(count)
                begin = at[:-1][full]
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                least = np.zeros((n, VALUES), np.uint32)
                if len(full):
                    one[full] = np.add.reduceat(words.mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                    two[full] = np.add.reduceat(words.mixed(values ^ np.uint64(0x3C3C3C3C3C3C3C3C)), begin)
                    least[full] = _minima(values, begin, VALUES)
                sizes.append(count)
                sums.append(one)
                xors.append(two)
                signed += [row.tobytes() if c else None for row, c in zip(least, count.tolist(), strict=True)]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        pa.array(np.concatenate(sizes).astype(np.int64)),
                        pa.array(np.concatenate(sums).view(np.int64)),
                        pa.array(np.concatenate(xors).view(np.int64)),
                        pa.array(signed, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "signature"],
                )

    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for n, values, at in _shingle_sets(batch["text"], k):
                lists = pa.ListArray.from_arrays(
                    pa.array(at.astype(np.int32)), pa.array(values.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, n), lists], ["id", "shingles"]
                )
                first += n

    return run


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long signatures of full sets, two bytes a value."""
    for batch in batches:
        sets = batch["shingles"]
        at = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy()))).astype(np.int64)
        flat = sets.flatten().to_numpy()
        for a, b in words.portions(at, words.SLICE // 4):
            least = _minima(flat[at[a] : at[b]], at[a:b] - at[a], LONG).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch["id"].slice(a, b - a), pa.array([row.tobytes() for row in least], pa.binary())],
                ["id", "signature"],
            )


def _matrix(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1)


def _prefixes(matrix: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the order and of ``depth`` values from where the order starts."""
    out = words.mixed(order.astype(np.uint64) + np.uint64(1 + depth * ORDERS))
    start = order * (VALUES // ORDERS)
    row = np.arange(len(matrix))
    for j in range(depth):
        out = words.mixed(out * np.uint64(3) + matrix[row, (start + j) % VALUES])
    return out.view(np.int64)


def _regions_of(depths: tuple[int, ...]) -> Callable:
    """Region at every depth, of every order of every class; of one order where rows name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                matrix, ids = _matrix(part["signature"]), part["id"].to_numpy()
                if "order_no" in part.schema.names:
                    orders = part["order_no"].to_numpy().astype(np.int64)
                else:
                    orders = np.tile(np.arange(ORDERS), len(ids))
                    ids, matrix = np.repeat(ids, ORDERS), np.repeat(matrix, ORDERS, axis=0)
                for depth in depths:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids),
                            pa.array(orders.astype(np.int32)),
                            pa.array(np.full(len(ids), depth, np.int32)),
                            pa.array(_prefixes(matrix, orders, depth)),
                        ],
                        ["id", "order_no", "depth", "region"],
                    )

    return run


def _placed(rows: DataFrame, depths: tuple[int, ...], name: str, most: int) -> DataFrame:
    """``(id, order_no, depth, region)`` with ``n``, the classes that share the region, and some of them.

    ``most``: rows there are at most, of classes in orders.
    """
    most *= len(depths)
    placed = scratch_table(
        rows.mapInArrow(_regions_of(depths), "id long, order_no int, depth int, region long"), name, rows=most
    )
    some = [F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(SOME)]
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.array(*some).alias("some")).where("n > 1")
    sizes = scratch_table(sizes, "sizes", rows=most // 2)
    return placed.join(small(sizes, sizes.count()), "region")


def regions(classes: DataFrame, n_classes: int) -> dict[str, DataFrame]:
    """``thin``: ``(region, id, order_no)`` of the regions that the first prefix made small;
    ``wide``: of the others, read on until few share them; ``extra``: where no prefix does,
    some of the region before, under ``ORDERS`` as their order; ``told``: ``(id, orders)``, what tells
    a class's region in every order; ``crowd``: ``(region, id)`` of what the first prefix
    did not bring below ``WIDE``.
    """
    most = n_classes * ORDERS
    first = _placed(classes.select("id", "signature"), LADDER[:1], "first-prefix", most).select("id", "order_no", "region", "n")
    thin = scratch_table(first.where(F.col("n") <= REGION).select("region", "id", "order_no"), "thin", rows=most)
    dense = scratch_table(first.where(F.col("n") > REGION), "dense", rows=most)
    # Only what one prefix crowds is read further.
    whole, crowd = dense.where(F.col("n") <= WIDE), dense.where(F.col("n") > WIDE)
    n_crowd = crowd.count()
    deeper = _placed(
        crowd.select("id", "order_no").join(classes.select("id", "signature"), "id"), LADDER, "prefixes", n_crowd
    )
    seen = F.struct("depth", "region", "n", "some")
    chosen = scratch_table(
        deeper.groupBy("id", "order_no").agg(
            # The shallowest prefix that few enough share, and the one before.
            F.min(F.when(F.col("n") <= WIDE, F.struct("depth", "region"))).alias("fitting"),
            F.max(F.when(F.col("n") > WIDE, seen)).alias("parent"),
        ),
        "chosen",
        rows=n_crowd,
    )
    fitting = chosen.where("fitting IS NOT NULL").select("id", "order_no", "fitting.*")
    place = F.array_position(F.array(*map(F.lit, LADDER)), F.col("depth")).cast("long")
    told = (
        thin.select("id", "order_no", F.lit(THIN).cast("long").alias("place"))
        .union(whole.select("id", "order_no", F.lit(1).cast("long")))
        .union(fitting.select("id", "order_no", place))
        .groupBy("id")
        .agg(F.bit_or(F.expr("shiftleft(place, 4 * order_no)")).alias("orders"))
    )
    # What no prefix fits, parted from a dense region at once or never, meets some of it;
    # where even whole signatures agree also a random share.
    alone = chosen.where("fitting IS NULL AND parent IS NOT NULL").select("id", "parent.*")
    met = alone.select("id", "region", F.explode("some").alias("other")).where("id <> other")
    ends = met.select(F.xxhash64("region", "id", "other").alias("region"), F.explode(F.array("id", "other")).alias("id"))
    block = F.pmod(F.xxhash64("id", "region"), F.ceil(2 * F.col("n") / WIDE))
    shares = alone.where(F.col("depth") == LADDER[-1]).select(F.xxhash64("region", block).alias("region"), "id")
    return {
        "thin": thin,
        "wide": whole.select("region", "id", "order_no").union(fitting.select("region", "id", "order_no")),
        "extra": shares.union(ends).withColumn("order_no", F.lit(ORDERS)),
        "told": told,
        "crowd": crowd.select("region", "id"),
    }


class _Labels:
    """Parts of a few rows, joined one by one."""

    def __init__(self, parts: np.ndarray):
        self.of = np.unique(parts, return_inverse=True)[1]

    def join(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Joins the parts of every pair in turn; which pairs did so."""
        did = []
        for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            if self.of[a] != self.of[b]:
                self.of[self.of == self.of[b]] = self.of[a]
                did.append(i)
        return did

    def one(self) -> bool:
        return bool((self.of == self.of[0]).all())


def _alike(matrix: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = (matrix[x[a : a + 8192]] == matrix[y[a : a + 8192]]).mean(axis=1)
    return out


def _place(orders: np.ndarray, order: int) -> np.ndarray:
    """What tells the region of every row in an order."""
    return (orders >> (4 * order)) & 15


def _met_before(
    head: np.ndarray, orders: np.ndarray, x: np.ndarray, y: np.ndarray, before: np.ndarray, thin: bool
) -> np.ndarray:
    """Whether a pair shares a region of the same kind in an order before, and so is told there."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(x), ROWS):
        i, j, upto = x[a : a + ROWS], y[a : a + ROWS], before[a : a + ROWS]
        same = head[i] == head[j]
        agreed = np.zeros((len(i), 2 * VALUES + 1), np.int16)
        np.cumsum(np.concatenate((same, same), axis=1), axis=1, out=agreed[:, 1:])
        for order in range(ORDERS):
            place = _place(orders[i], order)
            both = (place == _place(orders[j], order)) & (place > 0) & ((place == THIN) == thin) & (order < upto)
            rows, start = np.flatnonzero(both), order * (VALUES // ORDERS)
            depth = _DEPTHS[place[rows]]
            out[a + rows] |= agreed[rows, start + depth] - agreed[rows, start] == depth
    return out


def _steps(region: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one region, by how far they are apart; rows of a region lie together."""
    for step in range(1, len(region)):
        x = np.flatnonzero(region[step:] == region[:-step])
        if not len(x):
            return
        yield x, x + step


def _thin_pairs(
    region: np.ndarray, part: np.ndarray, order: np.ndarray, orders: np.ndarray, matrix: np.ndarray, least: float, forest: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of small regions, all at once: what each row may bring is bounded by ``REGION``."""
    left, right, close = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for x, y in _steps(region):
        apart = part[x] != part[y]
        x, y = x[apart], y[apart]
        alike = _alike(matrix, x, y)
        good = alike >= least
        left.append(x[good])
        right.append(y[good])
        close.append(alike[good])
    x, y, s = np.concatenate(left), np.concatenate(right), np.concatenate(close)
    before = _met_before(matrix, orders, x, y, order[x], True)
    if not forest:
        return x[~before], y[~before]
    # What was told before is joined first and silently; then the closest first.
    ranked = np.lexsort((-s, ~before))
    parent: dict[int, int] = {}

    def root(r: int) -> int:
        while parent.get(r, r) != r:
            parent[r] = parent.get(parent[r], parent[r])
            r = parent[r]
        return r

    kept = []
    for i in ranked.tolist():
        a, b = root(int(x[i])), root(int(y[i]))
        if a != b:
            parent[a] = b
            if not before[i]:
                kept.append(i)
    return x[kept], y[kept]


def _told_parts(labels: _Labels, orders: np.ndarray, order: int, matrix: np.ndarray, sure: float) -> None:
    """Joins rows that lie together in a wide region of an earlier order and are surely alike."""
    for earlier in range(order):
        place = _place(orders, earlier)
        rows = np.flatnonzero((place > 0) & (place != THIN))
        depth, key = _DEPTHS[place[rows]], place[rows].astype(np.uint64)
        for j in range(int(depth.max(initial=0))):
            on = np.flatnonzero(depth > j)
            key[on] = words.mixed(key[on] * np.uint64(3) + matrix[rows[on], (earlier * (VALUES // ORDERS) + j) % VALUES])
        by_key = np.argsort(key, kind="stable")
        rows, key = rows[by_key], key[by_key]
        same = np.flatnonzero(key[1:] == key[:-1])
        x, y = rows[same], rows[same + 1]
        apart = labels.of[x] != labels.of[y]
        x, y = x[apart], y[apart]
        close = _alike(matrix, x, y) >= sure
        labels.join(x[close], y[close])


def _wide_tree(part: np.ndarray, order: int, orders: np.ndarray, matrix: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one region's candidates, without what earlier orders tell."""
    head = matrix[:, :VALUES]
    least = least_estimate(threshold, VALUES), least_estimate(threshold, matrix.shape[1])
    sure = threshold + SURE * (threshold * (1 - threshold) / matrix.shape[1]) ** 0.5
    labels = _Labels(part)
    _told_parts(labels, orders, order, matrix, sure)
    told: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for x, y in _steps(np.zeros(len(part), np.int8)):
        if labels.one():
            break
        apart = labels.of[x] != labels.of[y]
        x, y = x[apart], y[apart]
        good = _alike(head, x, y) >= least[0]
        x, y = x[good], y[good]
        alike = _alike(matrix, x, y)
        close = alike >= sure
        did = labels.join(x[close], y[close])
        told.append((x[close][did], y[close][did]))
        late = (alike >= least[1]) & ~close
        waiting.append((x[late], y[late], alike[late]))
    if waiting:
        x, y, s = (np.concatenate(c) for c in zip(*waiting, strict=True))
        closest = np.argsort(-s, kind="stable")
        did = labels.join(x[closest], y[closest])
        told.append((x[closest][did], y[closest][did]))
    none = [np.empty(0, np.int64)]
    return np.concatenate(none + [x for x, _ in told]), np.concatenate(none + [y for _, y in told])


def _wide_pairs(part: np.ndarray, order: np.ndarray, orders: np.ndarray, matrix: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidates of one region whose ends lie in different parts, told in no order before."""
    if (part == part[0]).all():
        return
    head = matrix[:, :VALUES]
    for x, y in _steps(np.zeros(len(part), np.int8)):
        apart = part[x] != part[y]
        x, y = x[apart], y[apart]
        good = _alike(head, x, y) >= least_estimate(threshold, VALUES)
        x, y = x[good], y[good]
        good = _alike(matrix, x, y) >= least_estimate(threshold, matrix.shape[1])
        x, y = x[good], y[good]
        here = ~_met_before(head, orders, x, y, order[x], False)
        yield x[here], y[here]


def _pairs(threshold: float, wide: bool, forest: bool) -> Callable:
    """Candidate pairs of rows that lie together by region, their ends in different parts.

    A region has a bounded number of rows; those of a batch's last one wait for the next.
    Of wide regions one is held at a time, and what it gives is sent on before the next.
    """

    def found(region: np.ndarray, ids: np.ndarray, part: np.ndarray, order: np.ndarray, orders: np.ndarray, matrix: np.ndarray) -> Iterator[tuple]:
        cuts = np.concatenate(([0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]))
        if wide:
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = slice(a, b)
                if b - a < 2:
                    continue
                if forest:
                    told = [_wide_tree(part[rows], int(order[a]), orders[rows], matrix[rows], threshold)]
                else:
                    told = _wide_pairs(part[rows], order[rows], orders[rows], matrix[rows], threshold)
                for x, y in told:
                    yield ids[a + x], ids[a + y]
        else:
            a, least = 0, least_estimate(threshold, VALUES)
            while a < len(region):
                b = int(cuts[max(np.searchsorted(cuts, a) + 1, np.searchsorted(cuts, a + ROWS, "right") - 1)])
                rows = slice(a, b)
                x, y = _thin_pairs(region[rows], part[rows], order[rows], orders[rows], matrix[rows], least, forest)
                yield ids[a + x], ids[a + y]
                a = b

    def told(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows of whole regions."""
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch[c].to_numpy() for c in ("region", "id", "part", "order_no", "orders")]
            now = (*columns, _matrix(batch["signature"], np.uint16 if wide else np.uint32))
            now = now if kept is None else tuple(np.concatenate(x) for x in zip(kept, now, strict=True))
            whole = int(np.searchsorted(now[0], now[0][-1]))
            kept = tuple(x[whole:].copy() for x in now)
            if whole:
                yield tuple(x[:whole] for x in now)
        if kept is not None:
            yield kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in settled(batches):
            for pairs in found(*rows):
                if len(pairs[0]):
                    held.append(pairs)
                if sum(len(x) for x, _ in held) > PAIRS:
                    yield told(held)
                    held = []
        if held:
            yield told(held)

    return run


def candidates(placed: DataFrame, parts: DataFrame | None, signatures: DataFrame, threshold: float, wide: bool) -> DataFrame:
    """Distinct candidate pairs of the regions.

    Without ``parts`` a forest of each region; with them every pair whose ends lie in
    different ones.
    """
    rows = placed.join(signatures, "id")
    if parts is None:
        rows = rows.withColumn("part", F.col("id"))
    else:
        rows = rows.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    rows = rows.select("region", "id", "part", "order_no", "orders", "signature").repartition("region").sortWithinPartitions("region")
    return rows.mapInArrow(_pairs(threshold, wide, parts is None), "a long, b long").where("a <> b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets are as alike as asked."""
    percent = round(threshold * 100)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("both")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), "sa", "sb")
        .where(100 * F.col("both") >= percent * union)
        .select("a", "b")
    )


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (words.mixed(shingles.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the partition fall in every bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(_buckets(batch["shingles"].flatten().to_numpy()), minlength=BUCKETS)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])


def _rarest(common: np.ndarray, percent: int) -> Callable:
    """The rarest shingles of every set: one of them is in both of any two sets as alike as asked.

    ``common`` orders them, by bucket; any order is right.  ``leads``: the shingle is among
    the fewer that are enough on the smaller of two sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch["shingles"]
            at = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy()))).astype(np.int64)
            flat = sets.flatten().to_numpy()
            ids, component = batch["id"].to_numpy(), batch["component"].to_numpy()
            for a, b in words.portions(at, words.SLICE // 4):
                own, begin = flat[at[a] : at[b]], at[a : b + 1] - at[a]
                size = np.diff(begin)
                row = np.repeat(np.arange(b - a), size)
                order = np.lexsort((own, common[_buckets(own)], row))
                position = np.arange(len(own)) - begin[:-1][row]
                n = size[row]
                kept = position <= n - -(-percent * n // 100)
                leads = position <= n - -(-2 * percent * n // (100 + percent))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[order][kept]),
                        pa.array(ids[a:b][row[kept]]),
                        pa.array(component[a:b][row[kept]]),
                        pa.array(n[kept].astype(np.int32)),
                        pa.array(position[kept].astype(np.int32)),
                        pa.array(leads[kept]),
                    ],
                    ["shingle", "id", "component", "n", "position", "leads"],
                )

    return run


def cut_pairs(crowd: DataFrame, parts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """Pairs of classes of a cut region that can be as alike as asked, their ends in different parts.

    Every such pair is there: two sets that are alike enough share one of their rarest
    shingles, at places that leave enough of both.  ``None`` if no region has two parts.
    """
    percent = round(threshold * 100)
    placed = crowd.join(parts, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component"))
    ends = placed.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = scratch_table(ends.where("least < most").select("region"), "mixed")
    apart = placed.join(small(mixed, mixed.count()), "region", "left_semi").select("id", "component").distinct()
    apart = scratch_table(apart, "apart")
    many = apart.count()
    if not many:
        return None
    full = scratch_table(sets.join(small(apart, many), "id"), "cut-sets")
    million = 1_000_000
    share = min(million, -(-million * COUNTED // many))
    some = full.where(F.pmod(F.xxhash64("id"), F.lit(million)) < share).select("shingles")
    counted = some.mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(BUCKETS, np.int64)
    common[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    rows = scratch_table(
        full.mapInArrow(
            _rarest(common, percent), "shingle long, id long, component long, n int, position int, leads boolean"
        ),
        "rarest",
    )
    # A shingle's largest part is not joined with itself; its other members are with all.
    held = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if("leads").alias("led"))
    groups = held.groupBy("shingle").agg(
        F.max(F.struct("n", "component", "led")).alias("top"), F.sum("n").alias("n"), F.sum("led").alias("led"), F.count(F.lit(1)).alias("parts")
    )
    blocks = lambda count: F.ceil(count / BLOCK).cast("long")
    groups = scratch_table(
        groups.where("parts > 1 AND led > 0").select(
            "shingle",
            F.col("top.component").alias("top"),
            blocks(F.col("top.led")).alias("left_top"),
            blocks(F.col("led") - F.col("top.led")).alias("left_other"),
            blocks(F.col("top.n")).alias("right_top"),
            blocks(F.col("n") - F.col("top.n")).alias("right_other"),
        ),
        "groups",
    )
    rows = rows.join(small(groups, groups.count()), "shingle").withColumn("is_top", F.col("component") == F.col("top"))

    def dealt(side: str, against: str, side_rows: DataFrame) -> DataFrame:
        """Every row once for each block of the other side that it is joined with."""
        own = F.when(F.col("is_top"), F.col(f"{side}_top")).otherwise(F.col(f"{side}_other"))
        block = F.pmod(F.xxhash64("id"), own)
        other = F.expr(
            f"concat(transform(filter(sequence(0L, {against}_other), x -> x < {against}_other), x -> struct(false AS top, x AS no)),"
            f" transform(filter(sequence(0L, {against}_top), x -> x < {against}_top AND NOT is_top), x -> struct(true AS top, x AS no)))"
        )
        spread = side_rows.select("shingle", "id", "component", "n", "position", "is_top", block.alias("block"), F.explode(other).alias("other"))
        here, there = F.struct("is_top", "block"), F.struct("other.top", "other.no")
        ends = (here, there) if side == "left" else (there, here)
        names = [F.col(c).alias(f"{side}_{c}") for c in ("id", "component", "n", "position")]
        return spread.select(F.xxhash64("shingle", *ends).alias("cell"), *names)

    left, right = dealt("left", "right", rows.where("leads")), dealt("right", "left", rows)
    # Of two sets the smaller leads; what is left of both from the first common shingle must be enough.
    possible = f"""
        left_component <> right_component
        AND (left_n < right_n OR left_n = right_n AND left_id < right_id)
        AND 100L * left_n >= {percent}L * right_n
        AND {100 + percent}L * least(left_n - left_position, right_n - right_position) >= {percent}L * (left_n + right_n)
    """
    pairs = left.join(right, "cell").where(possible)
    return pairs.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch_table(texts.mapInArrow(_signatures(shingle), SIGNED), "signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    n_known = known.count()
    classes = scratch_table(
        known.groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "signature")).alias("m"))
        .select("d1", "d2", F.col("m.doc_id").alias("id"), F.col("m.signature").alias("signature")),
        "classes",
        rows=n_known,
    )
    n_classes = classes.count()
    placed = regions(classes, n_classes)
    thin, wide, crowd = placed["thin"], placed["wide"], placed["crowd"]
    told = scratch_table(placed["told"], "told", rows=n_classes)
    orders = F.coalesce("orders", F.lit(0).cast("long")).alias("orders")
    plain = classes.join(told, "id", "left").select("id", orders, "signature")
    thin_tree = scratch_table(candidates(thin, None, plain, threshold, False), "thin-tree", rows=n_classes * ORDERS)
    ends = thin_tree.select(F.col("a").alias("id")).union(thin_tree.select(F.col("b").alias("id")))
    crowded = scratch_table(wide.select("id").union(crowd.select("id")).distinct(), "crowded", rows=n_classes)
    asked = scratch_table(ends.union(crowded).distinct(), "asked", rows=n_classes)
    wanted = texts.join(small(asked, asked.count()), texts["doc_id"] == asked["id"], "left_semi")
    sets = scratch_table(wanted.mapInArrow(_sets(shingle), "id long, shingles array<long>"), "sets")
    in_crowd = sets.join(small(crowded, crowded.count()), "id", "left_semi")
    longer = scratch_table(in_crowd.mapInArrow(_long, "id long, signature binary"), "long")
    longer = longer.join(told, "id", "left").select("id", orders, "signature")

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs confirmed on full sets; a pair weighs as much as both its sets."""
        return scratch_table(confirmed(pairs, sets, threshold), "confirmed", rows=SET_WEIGHT * pairs.count())

    tree = scratch_table(
        thin_tree.union(candidates(wide, None, longer, threshold, True)).distinct(), "tree", rows=n_classes * ORDERS
    )
    links = linked(tree)
    parts = scratch_table(components(links), "parts", rows=n_classes)
    # What met only some of a region takes part now that most of it is linked.
    everywhere = wide.union(placed["extra"])
    apart = candidates(thin, parts, plain, threshold, False).union(candidates(everywhere, parts, longer, threshold, True))
    rest = scratch_table(apart.distinct().join(tree, ["a", "b"], "left_anti"), "rest")
    more = linked(rest)
    final = scratch_table(components(links.union(more)), "parts", rows=n_classes)
    cut = cut_pairs(crowd, final, sets, threshold)
    if cut is not None:
        last = linked(scratch_table(cut, "cut-pairs"))
        final = components(final.select(F.col("id").alias("a"), F.col("component").alias("b")).union(last))
    lowest = signed.join(classes.select("d1", "d2", "id"), ["d1", "d2"], "left").join(
        final, "id", "left"
    )
    component = F.coalesce("component", "id", "doc_id")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return lowest.select(
        "doc_id",
        "n_shingles",
        F.when(linked, component).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
