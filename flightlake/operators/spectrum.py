"""Power spectra of evenly spaced series.

A series that fits in one array is transformed as one.  A longer one is folded
into a matrix of about sqrt(n) x sqrt(n): transform the columns, turn each
element by its phase, transform the rows.  Either way a task holds one array of
bounded length, and a group is never larger than that array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlake.scale import join_per_key

FEWEST_SAMPLES = 4
LOG_FLOOR = 1e-8

#: Longest transform done as one array.
WHOLE = 1 << 16

_COMPLEX = T.StructType(
    [
        T.StructField("k", T.ArrayType(T.LongType())),
        T.StructField("re", T.ArrayType(T.DoubleType())),
        T.StructField("im", T.ArrayType(T.DoubleType())),
    ]
)


@F.pandas_udf(_COMPLEX)
def _transform(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Transform each sparse array: positions, real and imaginary parts, length.

    ``phase`` (column number over full length, 0 for none) turns the output for
    the second stage; ``keep`` limits the bins handed back.
    """
    for at, re, im, length, phase, keep in parts:
        ks, res, ims = [], [], []
        for p, r, m, n, turn, top in zip(at, re, im, length, phase, keep):
            x = np.zeros(n, dtype=complex)
            x[np.asarray(p, dtype=np.int64)] = np.asarray(r, dtype=float) + 1j * np.asarray(m, dtype=float)
            k = np.arange(top, dtype=np.int64)
            y = np.fft.fft(x)[:top]
            if turn:
                y = y * np.exp(-2j * np.pi * turn * k)
            ks.append(k)
            res.append(y.real)
            ims.append(y.imag)
        yield pd.DataFrame({"k": ks, "re": res, "im": ims})


def _bits(n: Column) -> Column:
    return F.length(F.bin(n))


def transform_plan(points: DataFrame, keys: Sequence[str], dt: DataFrame, zero_pad: bool = True) -> DataFrame:
    """Per key: samples used, transform length; keys with a gap or too few are absent."""
    sized = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))
    one = F.lit(1).cast("long")
    padded = F.call_function("shiftleft", one, _bits(F.col("n") - 1))
    cut = F.call_function("shiftleft", one, _bits(F.col("n")) - 1)
    return (
        sized.where((F.col("n") >= FEWEST_SAMPLES) & (F.col("n") == F.col("known")))
        .withColumn("nfft", padded if zero_pad else cut)
        .withColumn("used", F.least("n", "nfft"))
        .join(dt, list(keys))
        .where((F.col("dt") > 0) & (F.col("used") >= FEWEST_SAMPLES))
        .select(*keys, "used", "nfft", "dt")
    )


def power_spectrum(
    points: DataFrame,
    dt: DataFrame,
    keys: Sequence[str],
    window: str = "hann",
    zero_pad: bool = True,
) -> DataFrame:
    """One-sided power density per key and bin: ``k, freq, psd, df, nyquist, used``.

    ``points`` has keys, ``i`` (dense from 0) and ``value``; ``dt`` has one row
    per key with the spacing in seconds.
    """
    keys = list(keys)
    plan = transform_plan(points, keys, dt, zero_pad)
    if window == "hann":
        weight = 0.5 * (1 - F.cos(2 * F.pi() * F.col("i") / F.col("used")))
        power = F.lit(0.375) * F.col("used")  # sum of the squared weights
    else:
        weight, power = F.lit(1.0), F.col("used").cast("double")
    shaped = (
        join_per_key(points, plan, keys, "i")
        .where(F.col("i") < F.col("used"))
        .withColumn("x", F.col("value") * weight)
    )
    bins = _bins_whole(shaped.where(F.col("nfft") <= WHOLE), keys)
    longest = plan.agg(F.max("nfft")).first()[0]
    if longest is not None and longest > WHOLE:
        bins = bins.unionByName(_bins_folded(shaped.where(F.col("nfft") > WHOLE), keys))
    sides = F.when((F.col("k") == 0) | (F.col("k") * 2 == F.col("nfft")), 1.0).otherwise(2.0)
    return bins.select(
        *keys,
        "k",
        (F.col("k") / (F.col("nfft") * F.col("dt"))).alias("freq"),
        (sides * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.col("dt") / power).alias("psd"),
        (1 / (F.col("nfft") * F.col("dt"))).alias("df"),
        (0.5 / F.col("dt")).alias("nyquist"),
        "used",
    )


def _unpack(packed: DataFrame, keep: Sequence[str]) -> DataFrame:
    return packed.select(*keep, F.inline(F.arrays_zip(*[F.col(f"y.{c}").alias(c) for c in ("k", "re", "im")])))


def _bins_whole(shaped: DataFrame, keys: list[str]) -> DataFrame:
    packed = shaped.groupBy(*keys, "used", "nfft", "dt").agg(F.collect_list(F.struct("i", "x")).alias("p"))
    zeros = F.transform("p.x", lambda x: F.lit(0.0))
    top = (F.col("nfft") / 2).cast("long") + 1
    done = packed.withColumn("y", _transform(F.col("p.i"), F.col("p.x"), zeros, F.col("nfft"), F.lit(0.0), top))
    return _unpack(done, [*keys, "used", "nfft", "dt"])


def _bins_folded(shaped: DataFrame, keys: list[str]) -> DataFrame:
    meta = [*keys, "used", "nfft", "dt"]
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor((_bits(F.col("nfft")) - 1) / 2).cast("int"))
    columns = (
        shaped.withColumn("cols", wide)
        .withColumn("rows", (F.col("nfft") / F.col("cols")).cast("long"))
        .groupBy(*meta, "cols", "rows", (F.col("i") % F.col("cols")).alias("col"))
        .agg(F.collect_list(F.struct(F.floor(F.col("i") / F.col("cols")).alias("row"), "x")).alias("p"))
    )
    zeros = F.transform("p.x", lambda x: F.lit(0.0))
    first = columns.withColumn(
        "y",
        _transform(F.col("p.row"), F.col("p.x"), zeros, F.col("rows"), F.col("col") / F.col("nfft"), F.col("rows")),
    )
    turned = _unpack(first, [*meta, "cols", "rows", "col"]).withColumnRenamed("k", "k1")
    rows = turned.groupBy(*meta, "cols", "rows", "k1").agg(F.collect_list(F.struct("col", "re", "im")).alias("p"))
    second = rows.withColumn(
        "y", _transform(F.col("p.col"), F.col("p.re"), F.col("p.im"), F.col("cols"), F.lit(0.0), F.col("cols"))
    )
    return (
        _unpack(second, [*meta, "rows", "k1"])
        .withColumn("k", F.col("k1") + F.col("rows") * F.col("k"))
        .where(F.col("k") * 2 <= F.col("nfft"))
        .select(*meta, "k", "re", "im")
    )


def narrow_band(points: DataFrame, dt: DataFrame, keys: Sequence[str], bins: Sequence[int], window: str = "hann", zero_pad: bool = True) -> DataFrame:
    """Power density of a few chosen bins, by direct sums; no array is ever built."""
    keys = list(keys)
    plan = transform_plan(points, keys, dt, zero_pad)
    weight = 0.5 * (1 - F.cos(2 * F.pi() * F.col("i") / F.col("used"))) if window == "hann" else F.lit(1.0)
    power = (F.lit(0.375) if window == "hann" else F.lit(1.0)) * F.col("used")
    shaped = join_per_key(points, plan, keys, "i").where(F.col("i") < F.col("used"))
    angle = lambda k: 2 * F.pi() * ((F.col("i") * k) % F.col("nfft")) / F.col("nfft")
    x = F.col("value") * weight
    sums = []
    for k in bins:
        sums += [F.sum(x * F.cos(angle(k))).alias(f"re_{k}"), F.sum(x * F.sin(angle(k))).alias(f"im_{k}")]
    folded = shaped.groupBy(*keys, "used", "nfft", "dt").agg(*sums)
    each = F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"re_{k}").alias("re"), F.col(f"im_{k}").alias("im")) for k in bins]))
    sides = F.when((F.col("k") == 0) | (F.col("k") * 2 == F.col("nfft")), 1.0).otherwise(2.0)
    return (
        folded.select(*keys, "used", "nfft", "dt", each)
        .where(F.col("k") * 2 <= F.col("nfft"))
        .select(
            *keys, "k",
            (F.col("k") / (F.col("nfft") * F.col("dt"))).alias("freq"),
            (sides * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.col("dt") / power).alias("psd"),
        )
    )


def dominant_peak(spectrum: DataFrame, keys: Sequence[str], min_freq: float = 0.0) -> DataFrame:
    """Strongest bin above DC and ``min_freq``, the lowest on a tie."""
    top = F.max_by(F.struct("k", "freq", "psd"), F.struct("psd", -F.col("k")))
    return (
        spectrum.where((F.col("k") >= 1) & (F.col("freq") >= min_freq))
        .groupBy(*keys)
        .agg(top.alias("t"))
        .select(*keys, F.col("t.k").alias("k"), F.col("t.freq").alias("freq"), F.col("t.psd").alias("psd"))
    )


def log_view(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins above DC for a log axis: below the floor NULL; a flat key is absent."""
    keys = list(keys)
    shown = spectrum.where("k >= 1")
    power = F.when(F.col("psd") > 0, F.col("psd"))
    floor = (
        shown.groupBy(*keys)
        .agg(F.greatest(F.min(power), F.max(power) * LOG_FLOOR).alias("floor"), F.max(power).alias("top"))
        .where("top > 0")
    )
    return join_per_key(shown, floor.drop("top"), keys, "k").withColumn(
        "shown_psd", F.when(F.col("psd") >= F.col("floor"), F.col("psd"))
    )
