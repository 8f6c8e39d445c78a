"""Choosing rows: fields, windows, messages, search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.functions.values import SEARCH_TIME_FIELD, TIME_FIELDS
from flightlake.scale import join_per_key

# The series plotted first, in order of preference.
DEFAULT_FIELDS = (
    ("ATT", "Roll"),
    ("ATT", "Pitch"),
    ("GPS", "Alt"),
    ("BAT", "Volt"),
    ("VFR_HUD", "alt"),
    ("ATTITUDE", "roll"),
)
SHORTEST_FIELD_TERM = 2


def field(samples: DataFrame, message: str, name: str) -> DataFrame:
    """One series; a field the log does not carry simply has no rows."""
    return samples.where((F.col("message") == message) & (F.col("field") == name))


def is_one_of(refs: Sequence[tuple[str, str]]) -> Column:
    """Whether a row belongs to one of the fields, said so that a scan can prune by message."""
    return reduce(
        lambda some, ref: some | ((F.col("message") == ref[0]) & (F.col("field") == ref[1])), refs, F.lit(False)
    )


def fields(samples: DataFrame, refs: Sequence[tuple[str, str]]) -> DataFrame:
    return samples.where(is_one_of(refs))


def time_window(rows: DataFrame, t0: int, t1: int) -> DataFrame:
    """Both ends belong to the window; an inverted window is empty."""
    return rows.where(F.col("ts_us").between(t0, t1))


def interval_window(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows inside their own log's ``(t0, t1)``."""
    return (
        join_per_key(rows, intervals, ["log_id"], "seq")
        .where(F.col("ts_us").between(F.col("t0"), F.col("t1")))
        .drop("t0", "t1")
    )


def known_samples(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("value").isNotNull())


def drop_message(rows: DataFrame, message: str) -> DataFrame:
    return rows.where(F.col("message") != message)


def keep_messages(rows: DataFrame, messages: Sequence[str]) -> DataFrame:
    return rows.where(F.col("message").isin(*messages))


def signal_fields(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("field").isin(*TIME_FIELDS))


def default_fields(catalog: DataFrame) -> DataFrame:
    """Two preferred series per log, else the first signal of its first message."""
    rank = F.lit(None).cast("int")
    for at, (message, name) in reversed(list(enumerate(DEFAULT_FIELDS))):
        rank = F.when((F.col("message") == message) & (F.col("field") == name), at).otherwise(rank)
    signal = F.col("field") != SEARCH_TIME_FIELD
    pick = F.struct("message", "field")
    # Two slots by aggregation: the best rank, and the best one after it.
    best = catalog.withColumn("rank", rank).groupBy("log_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("rank").isNotNull(), F.struct("rank", "message", "field")))).alias("liked"),
        F.min_by(pick, F.when(signal, F.struct("first_seq", "message", "position"))).alias("fallback"),
    )
    chosen = F.when(
        F.size("liked") > 0,
        F.transform(F.slice("liked", 1, 2), lambda x: F.struct(x["message"].alias("message"), x["field"].alias("field"))),
    ).when(F.col("fallback").isNotNull(), F.array("fallback"))
    return best.select("log_id", F.posexplode(chosen).alias("pos", "ref")).select("log_id", "pos", "ref.message", "ref.field")


def chosen_fields(selected: DataFrame, extra: DataFrame) -> DataFrame:
    """Selected (list 0) then extra (list 1), each field once at its first place."""
    ranked = selected.select(F.lit(0).alias("list"), "pos", "message", "field").unionByName(
        extra.select(F.lit(1).alias("list"), "pos", "message", "field")
    )
    first = ranked.groupBy("message", "field").agg(F.min(F.struct("list", "pos")).alias("at"))
    return first.select("message", "field", "at.list", "at.pos")


def search_fields(catalog: DataFrame, raw: str) -> DataFrame:
    """Messages matching a search box, with the fields to show.

    A bare term looks in message and field names; ``a.b`` wants both.  Returns
    ``log_id, message, fields, hits, auto_expand``; a message's field list is as
    long as its format, never longer.
    """
    query = raw.strip().lower()
    dotted = "." in query
    message_term, _, field_term = query.partition(".") if dotted else (query, "", query)
    if len(field_term) < SHORTEST_FIELD_TERM:
        field_term = ""
    everything = not query or (dotted and not message_term and not field_term)

    plottable = catalog.where(F.col("field") != SEARCH_TIME_FIELD)
    name_hit = F.lit(True) if everything else F.lower("message").contains(message_term)
    hit = F.lower("field").contains(field_term) if field_term and not everything else F.lit(False)
    entry = F.struct("position", "field")
    grouped = plottable.groupBy("log_id", "message").agg(
        F.array_sort(F.collect_list(entry)).alias("_all"),
        F.array_sort(F.collect_list(F.when(hit, entry))).alias("_hits"),
    )
    found = F.size("_hits") > 0
    if everything:
        shown, narrow = F.lit(True), F.lit(False)
    elif dotted:
        shown = name_hit & found if field_term else name_hit
        narrow = F.lit(bool(field_term))
    else:
        shown, narrow = name_hit | found, ~name_hit
    names = lambda c: F.col(c)["field"]
    return grouped.where(shown).select(
        "log_id", "message",
        F.when(narrow, names("_hits")).otherwise(names("_all")).alias("fields"),
        names("_hits").alias("hits"),
        narrow.alias("auto_expand"),
    )


def search_params(params: DataFrame, raw: str) -> DataFrame:
    return params.where(F.upper("name").contains(raw.upper()))


def name_order(rows: DataFrame, *columns: str, within: Sequence[str] | None = None) -> DataFrame:
    """Order as a reader expects: case folded, underscores before digits.

    With ``within`` the rows keep no order but get their ``place`` in it, from 1 in each
    group; what is listed by name (the fields of a log) is short.
    """
    order = [F.collate(c, "UNICODE") for c in columns]
    if within is None:
        return rows.orderBy(*order)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def longest_series(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` messages of each log with most rows, ties broken by name."""
    best = Window.partitionBy("log_id").orderBy(F.desc("n_rows"), "message")
    return counts.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")
