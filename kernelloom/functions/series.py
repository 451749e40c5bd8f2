"""Cleaning, scaling, resampling, shifting and masking of series.

Two forms exist.  Array expressions serve series of a bounded length (a calendar's, a window's).
``*_long`` functions serve series of any length in long form (key, t, v): they are window functions,
which Spark spills, so no series has to fit an array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelloom.functions.arrays import at, finite, indices, mean, std_pop, tail, tile_to
from kernelloom.functions.draws import drawn

# -- long form -------------------------------------------------------------------------------------


def clean_long(df: DataFrame, key: str, t: str = "t", v: str = "v", out: str = "clean") -> DataFrame:
    """Adds ``out``: values that aren't finite are interpolated on the index; the edges take the
    nearest finite value; a series without any is all zeros.  ``t`` must be the position."""
    back = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    good = F.when(finite(F.col(v)), F.struct(F.col(t).cast("double").alias("t"), F.col(v).alias("v")))
    rows = df.withColumn("_g", good).withColumns({"_b": F.last("_g", True).over(back), "_a": F.first("_g", True).over(ahead)})
    lo, hi, here = F.col("_b"), F.col("_a"), F.col(t)
    between = lo["v"] + (hi["v"] - lo["v"]) * (here - lo["t"]) / F.nullif(hi["t"] - lo["t"], F.lit(0.0))
    value = F.when(F.col("_g").isNotNull(), F.col(v)).when(lo.isNull() & hi.isNull(), 0.0).when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(between)
    return rows.withColumn(out, value).drop("_g", "_b", "_a")


def impute_long(df: DataFrame, key: str, strategy: str, t: str = "t", v: str = "v", out: str = "filled") -> DataFrame:
    """Adds ``out`` by ``zero``, ``ffill`` (a leading gap takes the first observed value) or ``linear``."""
    if strategy == "linear":
        return clean_long(df, key, t, v, out)
    good = F.when(finite(F.col(v)), F.col(v))
    if strategy == "zero":
        return df.withColumn(out, F.coalesce(good, F.lit(0.0)))
    if strategy != "ffill":
        raise ValueError(f"no imputation named {strategy!r}")
    back = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("_g", good).withColumn(out, F.coalesce(F.last("_g", True).over(back), F.first("_g", True).over(ahead), F.lit(0.0))).drop("_g")


def smooth_long(df: DataFrame, key: str, window: int = 5, t: str = "t", v: str = "v", out: str = "smooth") -> DataFrame:
    """Adds ``out``: a centred moving average with edge padding; one pass of sums over a row frame.

    A window longer than the series shrinks to it, so short series need their length: one more window.
    """
    whole = Window.partitionBy(key)
    ordered = whole.orderBy(t)
    rows = df.withColumns({"_n": F.count("*").over(whole), "_i": F.row_number().over(ordered) - 1, "_f": F.first(v).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_l": F.last(v).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    left = window // 2
    right = window - 1 - left
    near = F.sum(v).over(ordered.rowsBetween(-left, right))
    padded = near + F.greatest(left - F.col("_i"), F.lit(0)) * F.col("_f") + F.greatest(right - (F.col("_n") - 1 - F.col("_i")), F.lit(0)) * F.col("_l")
    if window <= 1:
        return df.withColumn(out, F.col(v))
    # series shorter than the window: their own length is the window
    small = F.transform(indices(F.col("_n")), lambda k: k - (F.col("_n") / 2).cast("int"))
    values = F.collect_list(v).over(ordered.rowsBetween(-window, window))
    short = F.aggregate(small, F.lit(0.0), lambda a, k: a + at(values, F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col("_i") + k)))) / F.col("_n")
    return rows.withColumn(out, F.when(F.col("_n") == 1, F.col(v)).when(F.col("_n") < window, short).otherwise(padded / window)).drop("_n", "_i", "_f", "_l")


def run_mask_long(df: DataFrame, key: str, min_run: int = 5, t: str = "t", v: str = "v", out: str = "mask") -> DataFrame:
    """Adds ``out``: 0.0 for zeros and for values in a constant run of at least ``min_run`` (if that is
    2 or more), else 1.0.  Runs are islands: a run's number is the count of changes before it."""
    ordered = Window.partitionBy(key).orderBy(t)
    change = F.coalesce((F.col(v) != F.lag(v).over(ordered)).cast("int"), F.lit(0))
    rows = df.withColumn("_c", change).withColumn("_r", F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.count("*").over(Window.partitionBy(key, "_r"))
    inside = (length >= min_run) if min_run >= 2 else F.lit(False)
    return rows.withColumn("_n", length).withColumn(out, F.when((F.col(v) == 0) | inside, 0.0).otherwise(1.0)).drop("_c", "_r", "_n")


def robust_stats_long(df: DataFrame, key: str, v: str = "v", min_scale: float = 1e-6) -> DataFrame:
    """key, loc (median), scale: max(IQR / 1.349, 1.4826 MAD, population deviation, min_scale) over
    finite values; (0, 1) for a series without any.  Percentiles are exact aggregates: they keep counts
    of distinct values, not rows."""
    rows = df.select(key, F.when(finite(F.col(v)), F.col(v)).alias("v"))
    first = rows.groupBy(key).agg(F.median("v").alias("loc"), F.percentile("v", [0.25, 0.75]).alias("q"), F.stddev_pop("v").alias("sd"))
    mad = rows.join(first.select(key, "loc"), key).groupBy(key).agg(F.median(F.abs(F.col("v") - F.col("loc"))).alias("mad"))
    iqr = F.when(F.col("q")[1] > F.col("q")[0], (F.col("q")[1] - F.col("q")[0]) / 1.349).otherwise(0.0)
    scale = F.greatest(iqr, 1.4826 * F.col("mad"), F.col("sd"), F.lit(min_scale))
    return first.join(mad, key).select(key, F.coalesce("loc", F.lit(0.0)).alias("loc"), F.when(F.col("loc").isNull(), 1.0).otherwise(scale).alias("scale"))


# -- array form ------------------------------------------------------------------------------------


def _filled(values: np.ndarray, strategy: str) -> np.ndarray:
    x = np.asarray(values, float)
    good = np.flatnonzero(np.isfinite(x))
    if len(good) == len(x) or not len(good):
        return np.where(np.isfinite(x), x, 0.0)
    if strategy == "linear":
        return np.interp(np.arange(len(x)), good, x[good])
    return x[good[np.maximum(np.searchsorted(good, np.arange(len(x)), side="right") - 1, 0)]]


def impute(x: Column, strategy: str = "linear") -> Column:
    """Array form of ``impute_long``, over Arrow batches: in Catalyst a fold that carries neighbours copies
    its array at every step."""
    if strategy not in ("linear", "zero", "ffill"):
        raise ValueError(f"no imputation named {strategy!r}")
    if strategy == "zero":
        return F.transform(x, lambda v: F.when(finite(v), v).otherwise(0.0))

    @F.pandas_udf("array<double>")
    def filled(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _filled(r, strategy) for r in rows])

    return filled(x)


def clean(x: Column) -> Column:
    """Array form of ``clean_long``."""
    return impute(x, "linear")


def history_stats(history: Column) -> tuple[Column, Column]:
    """(mean, population deviation), the deviation 1 where it is below 1e-8."""
    kept = lambda s: F.when(s < 1e-8, 1.0).otherwise(s)
    return mean(history), F.get(F.transform(F.array(std_pop(history)), kept), F.lit(0))


def scaled(x: Column, mu: Column, sigma: Column) -> Column:
    return F.transform(x, lambda v: (v - mu) / sigma)


def unscaled(x: Column, mu: Column, sigma: Column) -> Column:
    return F.transform(x, lambda v: mu + sigma * v)


def transform_with_stats(x: Column, loc: Column, scale: Column, kind: str = "asinh") -> Column:
    z = lambda v: (v - loc) / F.greatest(scale, F.lit(1e-8))
    if kind == "identity":
        return F.transform(x, z)
    if kind == "asinh":
        return F.transform(x, lambda v: F.asinh(z(v)))
    raise ValueError(f"no transform named {kind!r}")


def inverse_transform_with_stats(x: Column, loc: Column, scale: Column, kind: str = "asinh") -> Column:
    """The inverse doesn't guard the scale; the forward transform does."""
    if kind == "identity":
        return F.transform(x, lambda v: loc + scale * v)
    if kind == "asinh":
        return F.transform(x, lambda v: loc + scale * F.sinh(v))
    raise ValueError(f"no transform named {kind!r}")


def resample(x: Column, length: int) -> Column:
    """Linear resampling on a grid of ``length`` points over the whole series, both ends included."""
    if length <= 0:
        raise ValueError("the target length must be positive")
    n = F.size(x)
    if length == 1:
        return F.slice(x, 1, 1)

    def value(i: Column) -> Column:
        p = i * (n - 1).cast("double") / F.lit(length - 1)
        lo = F.floor(p)
        a, b = at(x, lo), at(x, F.least(n - 1, lo + 1))
        return a + (p - lo) * (b - a)

    return F.when(n == length, x).when(n == 1, F.array_repeat(F.get(x, F.lit(0)), length)).when(n > 1, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), value)).otherwise(F.array().cast("array<double>"))


def shift(x: Column, by: int, fill: str = "edge") -> Column:
    """``x`` moved right by ``by`` (left if negative), at most by its length less one.

    ``edge`` repeats the edge value, ``wrap`` rolls, ``reflect`` mirrors without the edge.
    """
    if fill not in ("edge", "wrap", "reflect"):
        raise ValueError(f"no fill named {fill!r}")
    n = F.size(x)
    if by == 0:
        return x
    k = F.least(F.lit(abs(by)), n - 1)
    if by > 0:
        rest = F.slice(x, F.lit(1), n - k)
        new = {"edge": F.array_repeat(F.get(x, F.lit(0)), k), "wrap": F.slice(x, n - k + 1, k), "reflect": F.reverse(F.slice(x, F.lit(2), k))}[fill]
        moved = F.concat(new, rest)
    else:
        rest = F.slice(x, k + 1, n - k)
        new = {"edge": F.array_repeat(F.get(x, n - 1), k), "wrap": F.slice(x, F.lit(1), k), "reflect": F.reverse(F.slice(x, n - k, k))}[fill]
        moved = F.concat(rest, new)
    return F.when(n > 1, moved).otherwise(x)


def shift_mask(mask: Column, by: int) -> Column:
    """A shifted mask: what comes in counts as unobserved."""
    n = F.size(mask)
    k = F.least(F.lit(abs(by)), n)
    zeros = F.array_repeat(F.lit(0.0), k)
    if by == 0:
        return mask
    return F.concat(zeros, F.slice(mask, F.lit(1), n - k)) if by > 0 else F.concat(F.slice(mask, k + 1, n - k), zeros)


def smooth(x: Column, window: int = 5) -> Column:
    """Array form of ``smooth_long``."""
    n = F.size(x)
    if window <= 1:
        return x
    w = F.least(F.lit(window), n)
    left = F.floor(w / 2).cast("int")

    def value(_: Column, i: Column) -> Column:
        span = F.sequence(i - left, i - left + w - 1)
        return F.aggregate(span, F.lit(0.0), lambda a, k: a + at(x, F.greatest(F.lit(0), F.least(n - 1, k)))) / w

    return F.when(n > 1, F.transform(x, value)).otherwise(x)


def zero_mask(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(v != 0, 1.0).otherwise(0.0))


def run_mask(x: Column, min_run: int = 5) -> Column:
    """Array form of ``run_mask_long``, over Arrow batches."""

    def one(values: np.ndarray) -> np.ndarray:
        v = np.asarray(values, float)
        edge = np.flatnonzero(np.diff(v, prepend=np.nan) != 0)
        length = np.repeat(np.diff(edge, append=len(v)), np.diff(edge, append=len(v)))
        return np.where((v == 0) | ((length >= min_run) if min_run >= 2 else False), 0.0, 1.0)

    @F.pandas_udf("array<double>")
    def masks(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else one(r) for r in rows])

    return masks(x)


def crop_or_pad(x: Column, length: int, min_len: int | None = None, direction: str = "left", seed: Column | int = 0) -> Column:
    """Exactly ``length`` values, or null for a series shorter than ``min_len`` (``length // 2``).

    ``left`` keeps the tail of a long series and pads a short one in front; ``right`` keeps the head and
    pads behind.  The padding is a piece of the series itself that starts at a place drawn from ``seed``.
    """
    if direction not in ("left", "right"):
        raise ValueError(f"no direction named {direction!r}")
    n, least = F.size(x), length // 2 if min_len is None else min_len
    seed = F.lit(seed) if isinstance(seed, int) else seed
    missing = F.lit(length) - n
    start = F.pmod(drawn(seed, n), F.greatest(n - missing, F.lit(0)) + 1).cast("int")
    piece = F.slice(tile_to(x, n + missing), start + 1, F.greatest(missing, F.lit(0)))
    cut = tail(x, length) if direction == "left" else F.slice(x, F.lit(1), F.lit(length))
    padded = F.concat(piece, x) if direction == "left" else F.concat(x, piece)
    return F.when((n < least) | (n == 0), None).when(n >= length, cut).otherwise(padded)
