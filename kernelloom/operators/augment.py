"""Equal lengths, preparation of examples, and the augmentation grid."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.functions.arrays import std_pop
from kernelloom.functions.draws import RANGE, drawn
from kernelloom.functions.series import crop_or_pad, history_stats, scaled, shift_mask


def uniform_length(examples: DataFrame, length: int, future_len: int | None = None, min_len: int | None = None, seed: int = 0, keys: tuple[str, ...] = ("history", "future"), key: str = "sample_idx") -> DataFrame:
    """Examples whose series have equal lengths; a row with a series that is too short goes.

    Columns with "future" in their name keep their head and are padded behind.
    """
    made = {}
    for i, c in enumerate(k for k in keys if k in examples.columns):
        ahead = "future" in c
        made[c] = crop_or_pad(F.col(c), future_len or length if ahead else length, min_len, "right" if ahead else "left", F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed + i))))
    rows = examples.withColumns(made)
    return reduce(lambda df, c: df.where(F.col(c).isNotNull()), made, rows)


def length_report(examples: DataFrame, cropped: DataFrame, *by: str) -> DataFrame:
    """n_before, n_kept and n_dropped examples of ``uniform_length``, by the given columns."""
    before, kept = (df.groupBy(*by).agg(F.count("*").alias(n)) for df, n in ((examples, "n_before"), (cropped, "n_kept")))
    both = before.join(kept, list(by), "left") if by else before.join(kept)
    return both.select(*by, "n_before", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), (F.col("n_before") - F.coalesce("n_kept", F.lit(0))).alias("n_dropped"))


def prepare_examples(examples: DataFrame, feature=None) -> DataFrame:
    """Adds mu, sigma, history_n, future_n and x_model: ``feature`` of the row (a function from a dict of
    columns to a column), else history_n."""
    mu, sigma = history_stats(F.col("history"))
    rows = examples.withColumns({"mu": mu, "sigma": sigma})
    rows = rows.withColumns({"history_n": scaled(F.col("history"), F.col("mu"), F.col("sigma")), "future_n": scaled(F.col("future"), F.col("mu"), F.col("sigma"))})
    return rows.withColumn("x_model", feature({c: F.col(c) for c in rows.columns}) if feature else F.col("history_n"))


def with_stats(row: dict[str, Column]) -> Column:
    """A feature: the scaled history, then its mean, deviation, least and greatest value."""
    x = row["history_n"]
    mu, _ = history_stats(x)
    return F.concat(x, F.array(mu, std_pop(x), F.array_min(x), F.array_max(x)))


def multivariate(*names: str):
    """A feature: the named series as channels, time-major."""
    return lambda row: F.transform(F.arrays_zip(*[row[n].alias(f"c{i}") for i, n in enumerate(names)]), lambda e: F.array(*[e[f"c{i}"] for i in range(len(names))]))


def noise(x: Column, sigma: float, seed: Column) -> Column:
    """Normal noise of ``sigma`` times the series' deviation (``sigma`` itself for a constant series), by
    the Box-Muller rule on two draws by the seed and the place, so reruns repeat it."""
    if sigma <= 0:
        return x
    spread = F.coalesce(std_pop(x), F.lit(0.0)) * sigma
    scale = F.when(spread < 1e-12, sigma).otherwise(spread)
    uniform = lambda i, salt: (drawn(seed, i, F.lit(salt)) + 0.5) / float(RANGE)
    normal = lambda i: F.sqrt(-2 * F.log(uniform(i, 1))) * F.cos(6.283185307179586 * uniform(i, 2))
    # the scale stands outside the inner function, which would make it anew for each value
    return F.transform(F.array(scale), lambda s: F.transform(x, lambda v, i: v + s * normal(i)))[0]


def _moved(x: np.ndarray, by: int, fill: str) -> np.ndarray:
    """``series.shift`` of one series."""
    n, k = len(x), min(abs(by), len(x) - 1)
    if by == 0 or n < 2:
        return x
    if by > 0:
        new = {"edge": np.full(k, x[0]), "wrap": x[n - k :], "reflect": x[1 : k + 1][::-1]}[fill]
        return np.concatenate([new, x[: n - k]])
    new = {"edge": np.full(k, x[-1]), "wrap": x[:k], "reflect": x[n - k - 1 : n - 1][::-1]}[fill]
    return np.concatenate([x[k:], new])


def _averaged(x: np.ndarray, window: int) -> np.ndarray:
    """``series.smooth`` of one series."""
    n, w = len(x), min(window, len(x))
    if n < 2 or w < 2:
        return x
    padded = x[np.clip(np.arange(n + w - 1) - w // 2, 0, n - 1)]
    return np.lib.stride_tricks.sliding_window_view(padded, w).mean(1)


def augment(prepared: DataFrame, shifts: tuple[int, ...] = (), fill: str = "edge", window: int | None = None, sigma: float | None = None, seed: int = 0, feature=None, key: str = "sample_idx") -> DataFrame:
    """The whole grid {0, *shifts} x {plain, smoothed} x {plain, noisy} of each example, the original
    included, with shift, smoothed and noisy.

    Shift and smoothing act on history and future as one series, over Arrow batches: as Catalyst's lambdas
    each of the grid's arrays was interpreted value by value.  Both parts are scaled anew by the new
    history; a mask moves along; x_model is made anew, by ``feature`` or as history_n; raw columns stay.
    """
    if fill not in ("edge", "wrap", "reflect"):
        raise ValueError(f"no fill named {fill!r}")
    cells = [(by, smoothed, noisy) for by in dict.fromkeys((0, *shifts)) for smoothed in ((False, True) if window else (False,)) for noisy in ((False, True) if sigma else (False,))]
    grid = F.array(*[F.struct(F.lit(by).alias("shift"), F.lit(smoothed).alias("smoothed"), F.lit(noisy).alias("noisy")) for by, smoothed, noisy in cells])

    @F.pandas_udf("array<double>")
    def made_of(series: pd.Series, by: pd.Series, smoothed: pd.Series) -> pd.Series:
        moved = (_moved(np.asarray(x, float), b, fill) for x, b in zip(series, by))
        return pd.Series([_averaged(x, window) if s else x for x, s in zip(moved, smoothed)])

    n = F.size("history_n")
    rows = prepared.withColumn("_g", F.explode(grid)).withColumn("_x", made_of(F.concat("history_n", "future_n"), F.col("_g.shift"), F.col("_g.smoothed")))
    rows = rows.withColumns({"_h": F.slice("_x", F.lit(1), n), "_f": F.slice("_x", n + 1, F.size("future_n"))})
    if sigma:
        word = lambda c: F.when(c, "True").otherwise("False")
        names = lambda i: F.concat_ws("|", F.col(key).cast("string"), F.concat_ws(" ", F.lit(str(seed)), F.col("_g.shift").cast("string"), word(F.col("_g.smoothed")), F.lit(str(i))))
        both = [F.when(F.col("_g.noisy"), noise(F.col(c), sigma, names(i))).otherwise(F.col(c)).alias(c) for i, c in enumerate(("_h", "_f"))]
        # a generator's output is made once; columns would be put in wherever their names stand
        rows = rows.withColumn("_n", F.explode(F.array(F.struct(*both)))).withColumns({"_h": F.col("_n._h"), "_f": F.col("_n._f")}).drop("_n")
    mu, sd = history_stats(F.col("_h"))
    rows = rows.withColumns({"_mu": mu, "_sd": sd})
    made = {"history_n": scaled(F.col("_h"), F.col("_mu"), F.col("_sd")), "future_n": scaled(F.col("_f"), F.col("_mu"), F.col("_sd")), "shift": F.col("_g.shift"), "smoothed": F.col("_g.smoothed"), "noisy": F.col("_g.noisy")}
    if "mask" in prepared.columns:
        places = [F.when(F.col("_g.shift") == by, shift_mask(F.col("mask"), by)) for by in dict.fromkeys((0, *shifts))]
        made["mask"] = F.coalesce(*places)
    rows = rows.withColumns(made).drop("_g", "_x", "_h", "_f", "_mu", "_sd")
    return rows.withColumn("x_model", feature({c: F.col(c) for c in rows.columns}) if feature else F.col("history_n"))
