"""How five filters work together, in every order they can be applied in.

A document's failures are five bits, its *mask*.  Documents are counted per part, mask and
label, so what is left of a corpus is at most 128 *cells* a part.  Each cell is folded across
the array of all 120 orders: ``transform`` goes over the orders, ``aggregate`` over an
order's five steps, carrying whether the cell is still there.  That gives 600 structs of
document counts, one for each order and step; a part's cells are merged by elementwise sums.

Whether a text stands in a document of a smaller id is told by the smallest id of its
digest: those are found by a partial minimum, and joined back on digest *and* id, so a text
that a third of all rows share is no hot key.

Defined results: null text is empty (it fails A, has no distinct words to fail B, and is a
copy of any other empty text); a null source is the part ``''``, together with documents
whose source is empty; a document without a label has neither; one with several label rows
has what any of them says; rows with equal id and text are each counted, none a copy of the
other; a null id is larger than none, so such a row is never a copy; an empty table has no
parts and gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.llm.common import scratch_table

LETTERS = "ABCDE"
#: All orders of the filters.
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: A filter's bit in a mask.
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
#: What is counted of each order and step.
COUNTED = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space other than the plain space.
OTHER_SPACES = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Maximal runs of what is not ASCII white space."""
    plain = F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES))
    return F.array_remove(F.split(plain, " "), "")


def failures_by_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, mask)`` with the bits of the filters that see a text alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        words_of(text).alias("words"),
        F.length(text).alias("n_chars"),
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).alias("n_capitals"),
        text.rlike(MARKS).alias("marked"),
    )
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = (
        n_words < LEAST_WORDS,
        100 * n_distinct.cast("long") < LEAST_DISTINCT * n_words.cast("long"),
        100 * F.col("n_capitals").cast("long") > MOST_CAPITALS * F.col("n_chars").cast("long"),
        F.col("marked"),
    )
    bits = (F.when(fail, F.lit(bit)).otherwise(F.lit(0)) for fail, bit in zip(fails, BIT.values(), strict=False))
    mask = sum(bits, F.lit(0))
    return own.select("doc_id", "part", "digest", mask.alias("mask"))


def labels_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, good, toxic)``, one row an id."""
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) == 1
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents by the filters they fail and their labels."""
    seen = scratch_table(failures_by_text(docs), "failures")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    first = first.withColumn("is_first", F.lit(True))
    known = seen.join(first, ["digest", "doc_id"], "left").join(labels_of(labels), "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("mask") + F.when(copy, F.lit(BIT["E"])).otherwise(F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return (
        known.select("part", mask.alias("mask"), flag("good"), flag("toxic"))
        .groupBy("part", "mask", "good", "toxic")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _counts(**said: Column) -> Column:
    return F.struct(*[said[name].cast("long").alias(name) for name in COUNTED])


def folded(cell: Column) -> Column:
    """A cell's documents at each step of each order: 600 structs, order by order."""
    orders = F.array(*[F.array(*[F.lit(BIT[letter]) for letter in order]) for order in ORDERS])
    none = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        here, gone = state["there"] & fails, ~state["there"] & fails
        alone = cell["mask"] == bit
        weigh = lambda true: F.when(true, cell["n"]).otherwise(none)
        counts = _counts(
            kept=weigh(state["there"] & ~fails),
            removed=weigh(here),
            redundant=weigh(gone),
            unique_fails=weigh(alone),
            good_lost=weigh(here & cell["good"]),
            toxic_lost=weigh(here & cell["toxic"]),
        )
        return F.struct(
            (state["there"] & ~fails).alias("there"), F.concat(state["steps"], F.array(counts)).alias("steps")
        )

    def one_order(order: Column) -> Column:
        empty = F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTED)}>>")
        start = F.struct(F.lit(True).alias("there"), empty.alias("steps"))
        return F.aggregate(order, start, step, lambda state: state["steps"])

    return F.flatten(F.transform(orders, one_order))


def added(one: Column, other: Column) -> Column:
    """Two arrays of counts, summed element by element."""
    return F.zip_with(
        one, other, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTED])
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, <COUNTED>, shapley)``, 600 rows a part."""
    n_steps = len(ORDERS) * len(LETTERS)
    zeros = F.array_repeat(_counts(**{c: F.lit(0) for c in COUNTED}), n_steps)
    names = F.array(*[F.lit(order) for order in ORDERS])
    held = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    merged = held.select(
        "part", F.aggregate("cells", zeros, lambda total, cell: added(total, folded(cell))).alias("steps")
    )
    told = merged.select("part", F.posexplode("steps").alias("at", "counts")).select(
        "part",
        F.element_at(names, (F.col("at") / len(LETTERS)).cast("int") + 1).alias("filter_order"),
        (F.col("at") % len(LETTERS) + 1).alias("step"),
        "counts.*",
    ).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    share = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return told.select("part", "filter_order", "step", *COUNTED, share.alias("shapley"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
                 regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e
          FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS f, a::INT + b::INT + c::INT + d::INT + e::INT AS k,
             count(*) AS n FROM fails GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, s::INT AS step, filter_order[s] AS filter, string_split(filter_order[1:s - 1], '') AS earlier
          FROM orders, range(1, 6) AS r(s)),
cell AS (SELECT part, filter_order, step, filter, good, toxic, n, k, f[filter] AS fails,
                len(list_filter(earlier, lambda y: y <> '' AND f[y])) > 0 AS gone FROM m, steps),
told AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN NOT gone AND fails AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN NOT gone AND fails AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
         FROM cell GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM told
"""
