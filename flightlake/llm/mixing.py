"""Mixing sources to target weights by systematic sampling.

Every source has a target of words.  A document's expected copies are its source's target
by its source's size; they are prefix-summed within the source, one random offset is added,
and a document is emitted once for each integer boundary its stretch crosses.  Expected
copies are the same for all of a source, so the prefix sum is a rank times a fraction; both
are whole numbers here, and no rounding can add or lose a copy.  Documents stand in order
of size, so what a source gives differs from its target by less than its longest document.

Ranks come from a range partition by source, size and id: a source that holds a third of
all rows spans many partitions, and only counts per source and partition are carried.

Defined results: null text has size 0 and may be taken like any other, adding no words; a
null source is a source of its own, the last; sources without a word have target 0 and give
nothing; rows that repeat are documents of their own, with equal size and id in any order;
an empty table gives no rows.  Columns beside id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.llm.common import scratch_table, small

#: Words stand between these.
SPACED_WORD = "[^ \\t\\n\\x0B\\f\\r]+"
WEIGHTS = (5, 2, 1)
#: Words taken of all sources, in percent of all words, and how often one may be taken.
SHARE, MOST = 150, 2
#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
ROW_BITS = 33

_WHOLE = "decimal(38,0)"


def in_pieces(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` dealt out by ranges of ``order``, with ``piece`` and ``at``, the row's place in it.

    Written once, so that places are the same however often they are read.
    """
    number = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", number)
    placed = ranged.select(
        *rows.columns,
        F.shiftright("number", ROW_BITS).alias("piece"),
        F.col("number").bitwiseAND((1 << ROW_BITS) - 1).alias("at"),
    )
    return scratch_table(placed, "pieces")


def ranked(rows: DataFrame, group: str | None, *order: Column) -> DataFrame:
    """``rows`` with ``place``: how many rows of its group come before, in the given order.

    ``order`` begins with the group, if any.  What pieces carry is a row per piece and group.
    """
    placed = in_pieces(rows, *order)
    keys = ["piece"] if group is None else ["piece", group]
    held = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("piece") if group is None else Window.partitionBy(group).orderBy("piece")
    earlier = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = scratch_table(held.withColumn("earlier", earlier - F.col("first")), "carried")
    names = {k: f"_c_{k}" for k in keys}
    carried = small(carried.select(*keys, "earlier").withColumnsRenamed(names), carried.count())
    same = [placed[k].eqNullSafe(carried[v]) for k, v in names.items()]
    return placed.join(carried, same).select(*rows.columns, (F.col("earlier") + F.col("at")).alias("place"))


def weighed(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` with the weight of every source: by code point, null last, weights repeating."""
    order = F.col("source").asc_nulls_last()
    dealt = F.array(*map(F.lit, weights))
    weight = F.element_at(dealt, (F.col("place") % len(weights) + 1).cast("int"))
    return ranked(sizes, None, order).select("source", "source_size", weight.cast("long").alias("weight"))


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST
) -> DataFrame:
    """``(source, source_size, target, above, below)``: ``above / below`` are expected copies.

    Targets go by weight; one that is over ``most`` times its source's size stops there, and
    what is left over is shared anew.  A round of that is one sum over the sources, and each
    caps at least one more.
    """
    known = scratch_table(weighed(sizes, weights), "sources")
    capped, now = -1, F.lit(False)
    while True:
        n, spent, weight, total = known.agg(
            F.count_if(now),
            F.sum(F.when(now, F.col("source_size").cast(_WHOLE) * most)),
            F.sum(F.when(~now, F.col("weight").cast(_WHOLE))),
            F.sum(F.col("source_size").cast(_WHOLE)),
        ).first()
        left, weight = share * int(total or 0) - 100 * int(spent or 0), int(weight or 0)
        if n == capped or not weight:
            break
        capped = n
        # share * weight / weights > most * size, in whole numbers
        over = F.lit(left).cast(_WHOLE) * F.col("weight") > F.lit(100 * most * weight).cast(_WHOLE) * F.col("source_size")
        now = now | over
    above = F.when(now, F.lit(most)).otherwise(F.lit(left).cast(_WHOLE) * F.col("weight"))
    below = F.when(now, F.lit(1)).otherwise(F.lit(100 * max(weight, 1)).cast(_WHOLE) * F.col("source_size"))
    target = F.when(now, (F.col("source_size") * most).cast("double")).otherwise(
        (F.lit(left).cast(_WHOLE) * F.col("weight")).cast("double") / F.lit(float(100 * max(weight, 1)))
    )
    some = F.col("source_size") > 0
    return known.select(
        "source",
        "source_size",
        F.when(some, target).otherwise(F.lit(0.0)).alias("target"),
        F.when(some, above).otherwise(F.lit(0)).cast(_WHOLE).alias("above"),
        F.when(some, below).otherwise(F.lit(1)).cast(_WHOLE).alias("below"),
    )


def offset(source: Column, below: Column) -> Column:
    """One number from 0 to ``below`` (excluded) for every source, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("")))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast(_WHOLE), below)


def crossed(place: Column, above: Column, below: Column, start: Column) -> Column:
    """Integer boundaries between a document's prefix sum and the next, both moved by the offset."""

    def upto(n: Column) -> Column:
        """Boundaries passed by the first ``n`` documents."""
        moved = (n.cast("decimal(18,0)") * above.cast("decimal(19,0)") + start).cast(_WHOLE)
        return F.call_function("div", moved, below)

    return upto(place + 1) - upto(place)


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every document."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACED_WORD)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    sized = scratch_table(sized, "sizes")
    sources = scratch_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    order = (F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last())
    placed = ranked(sized, "source", *order)
    sources = small(sources.withColumnRenamed("source", "_source"), sources.count())
    joined = placed.join(sources, placed["source"].eqNullSafe(sources["_source"]))
    copies = crossed(F.col("place"), F.col("above"), F.col("below"), offset(F.col("source"), F.col("below")))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
named AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM named),
-- sources are capped in order of size by weight; the first that need not be tells the level
ordered AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                   sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
                   sum(source_size) OVER () AS total FROM weighed),
level AS (SELECT 150 * total::HUGEINT - 200 * capped::HUGEINT AS rest, open::HUGEINT AS open FROM ordered
          WHERE (150 * total::HUGEINT - 200 * capped::HUGEINT) * weight <= 200 * open::HUGEINT * source_size
          ORDER BY open DESC LIMIT 1),
goals AS (SELECT source, source_size, weight, coalesce(rest * weight <= 200 * open * source_size, false) AS inside, rest, open
          FROM weighed LEFT JOIN level ON true),
targets AS (SELECT source, source_size,
                   CASE WHEN source_size = 0 THEN 0.0 WHEN inside THEN (rest * weight)::DOUBLE / (100 * open)::DOUBLE ELSE 2.0 * source_size END AS target,
                   CASE WHEN source_size = 0 THEN 0 WHEN inside THEN rest * weight ELSE 2 END::HUGEINT AS above,
                   CASE WHEN source_size = 0 THEN 1 WHEN inside THEN 100 * open * source_size ELSE 1 END::HUGEINT AS below FROM goals),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST)::HUGEINT AS place FROM sized),
moved AS (SELECT doc_id, size, source_size, target, above, below, place,
                 ('0x' || substring(md5('mix:' || coalesce(p.source, '')), 1, 15))::BIGINT::HUGEINT % below AS start
          FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * ((place * above + start) // below - ((place - 1) * above + start) // below))::BIGINT AS taken FROM moved
"""
