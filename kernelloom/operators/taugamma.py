"""Kernels over time from shifted windows (tau), and forecasts through them (gamma)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.functions.arrays import finite, observed, tail
from kernelloom.functions.series import impute, robust_stats_long, transform_with_stats
from kernelloom.operators.pairwise import partial_sums, stack


def common_context(bank: DataFrame, horizon: int = 0, requested: int | None = None, power_of_two: bool = False, col: str = "train") -> int:
    """The least length less the horizon; ``requested`` may not exceed it."""
    n = (bank.select(F.min(F.size(col))).first()[0] or 0) - horizon
    if n <= 0:
        raise ValueError("no series is longer than the horizon")
    if requested is not None and requested > n:
        raise ValueError(f"a context of {requested} exceeds the common length {n}")
    n = n if requested is None else requested
    return 1 << (n.bit_length() - 1) if power_of_two else n


def prepare_bank(bank: DataFrame, context: int, transform: str = "asinh", strategy: str = "linear", min_scale: float = 1e-6, key: str = "k") -> DataFrame:
    """Per series: loc and scale from the observed context only; scaled and filled train, context and
    future, each filled by itself; masks; the share of missing values in percent."""
    rows = bank.withColumns({"train": observed(F.col("train")), "future": observed(F.col("future"))}).withColumn("context", tail(F.col("train"), context))
    stats = robust_stats_long(rows.select(key, F.explode("context").alias("v")), key, min_scale=min_scale)
    rows = rows.join(stats, key)
    for part in ("train", "context", "future"):
        rows = rows.withColumn(f"{part}_scaled", transform_with_stats(F.col(part), F.col("loc"), F.col("scale"), transform))
        rows = rows.withColumns({f"{part}_filled": impute(F.col(f"{part}_scaled"), strategy), f"{part}_mask": F.transform(part, lambda v: F.coalesce(finite(v), F.lit(False)))})
    missing = lambda p: F.when(F.size(p) > 0, F.size(F.filter(f"{p}_mask", lambda m: ~m)) * 100.0 / F.size(p)).otherwise(0.0)
    return rows.withColumns({"context_missing_pct": missing("context"), "future_missing_pct": missing("future"), "transform": F.lit(transform)})


def support_bank(series: DataFrame, horizon: int, requested: int | None = None, power_of_two: bool = False, unseen: tuple[str, int] | None = None, transform: str = "asinh", strategy: str = "linear") -> tuple[DataFrame, int]:
    """(bank, context) of series (dataset, series_index, train, future): every series prepared with one common
    context, named ``dataset#seriesN``, with its key ``k`` the name; ``unseen`` marks the series that
    isn't to be learnt from.  Futures are cut to the horizon."""
    context = common_context(series, horizon, requested, power_of_two)
    name = F.concat("dataset", F.lit("#series"), F.col("series_index").cast("string"))
    apart = (F.col("dataset") == unseen[0]) & (F.col("series_index") == unseen[1]) if unseen else F.lit(False)
    rows = series.select("dataset", "series_index", name.alias("k"), name.alias("name"), apart.alias("unseen"), "train", F.slice("future", 1, horizon).alias("future"))
    return prepare_bank(rows, context, transform, strategy), context


def summarize_bank(bank: DataFrame) -> DataFrame:
    return bank.select("name", F.size("context").cast("long").alias("context_length"), F.size("future").cast("long").alias("horizon_length"), "context_missing_pct", "future_missing_pct", "loc", "scale")


def tau_array(length: Column, context: int, max_taus: int | None = None, include_current: bool = True) -> Column:
    """Look-backs from 0 (or 1) to length - context, thinned evenly to ``max_taus`` (the context)."""
    first, last = (0 if include_current else 1), length - context
    taus = F.when(last >= first, F.sequence(F.lit(first), F.greatest(last, F.lit(first)))).otherwise(F.array().cast("array<int>"))
    m = context if max_taus is None else max_taus
    if m <= 0:
        return taus
    n = F.size(taus)
    step = (n - 1).cast("double") / F.lit(max(m - 1, 1)) if m > 1 else F.lit(0.0)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.when((k == m - 1) & F.lit(m > 1), n - 1).otherwise(F.floor(k * step).cast("int"))))
    return F.when(n <= m, taus).otherwise(F.transform(places, lambda p: F.get(taus, p)))


def _window_products(x: np.ndarray, taus: np.ndarray, context: int, alpha: float, omega: float, block: int = 1024) -> np.ndarray:
    """The mean over the look-backs of the outer product of the weighted windows, in blocks of windows."""
    start = len(x) - context - taus
    most, start, taus = max(1, int(taus.max())), start[(start >= 0) & (taus >= 0)], taus[(start >= 0) & (taus >= 0)]
    places, total = np.linspace(0, 1, context) if context > 1 else np.zeros(1), np.zeros((context, context))
    for i in range(0, len(taus), block):
        windows = x[start[i : i + block, None] + np.arange(context)]
        at = np.clip(taus[i : i + block] / most, 0, 1)
        w = windows * (np.exp(-alpha * omega**2 * (places[None] - at[:, None]) ** 2) if context > 1 else 1.0)
        total += w.T @ w
    return total / max(1, len(taus))


def time_kernels(bank: DataFrame, context: int, alpha: float = 1.0, omega: float = 1.0, max_taus: int | None = None, key: str = "k", taus: DataFrame | None = None) -> DataFrame:
    """(key, r, c, value): each series' kernel over window places, the mean over its look-backs of the
    outer product of the weighted window.  ``taus`` (key, taus) overrides the look-backs of some series.

    One product of matrices a series, over blocks of its windows; a series without a window has no row.
    """
    rows = bank.withColumn("taus", tau_array(F.size("train_filled"), context, max_taus))
    if taus is not None:
        rows = rows.join(taus.withColumnRenamed("taus", "_own"), key, "left").withColumn("taus", F.coalesce("_own", "taus")).drop("_own")
    r, c = (g.ravel() for g in np.indices((context, context)))

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, x, own in part.itertuples(index=False):
                own = np.asarray(own, np.int64)
                if len(own) and (len(x) - context - own >= 0).any():
                    value = _window_products(np.asarray(x, float), own, context, alpha, omega)
                    yield pd.DataFrame({key: k, "r": r, "c": c, "value": value.ravel()})

    return rows.select(key, "train_filled", "taus").mapInPandas(products, f"{key} {dict(bank.dtypes)[key]}, r int, c int, value double")


def mean_time_kernel(kernels: DataFrame) -> DataFrame:
    """(r, c, value): the mean over all series."""
    return kernels.groupBy("r", "c").agg(F.avg("value").alias("value"))


def dense(kernel: DataFrame, n: int) -> np.ndarray:
    """A time kernel as an array: context^2 cells, however many series stand behind it."""
    out, rows = np.zeros((n, n)), kernel.select("r", "c", "value").toPandas()
    out[rows["r"], rows["c"]] = rows["value"]
    return out


def energy(vectors: DataFrame, own: DataFrame, shared: np.ndarray, nugget: float = 1e-5, key: str = "k") -> DataFrame:
    """key, energy: u' K_i u with u = (K + nugget I)^-1 v, for vectors (key, v) and their own kernels."""
    inverse = np.linalg.inv(shared + nugget * np.eye(len(shared)))

    @F.pandas_udf("array<double>")
    def solved(v: pd.Series) -> pd.Series:
        return pd.Series([inverse @ np.asarray(x, float) for x in v])

    u = vectors.select(key, solved("v").alias("u"))
    return own.join(u, key).groupBy(key).agg(F.sum(F.get("u", F.col("r")) * F.col("value") * F.get("u", F.col("c"))).alias("energy"))


def gamma_gram(left: DataFrame, right: DataFrame | None, time_kernel: np.ndarray, lam: float, col: str = "x", mask: str | None = None) -> DataFrame:
    """(i, j, value) of x (K + lam I)^-1 x' between contexts; masked places count as 0."""
    from kernelloom.operators.pairwise import pair_values

    inverse = np.linalg.inv(time_kernel + lam * np.eye(len(time_kernel)))

    def shown(t: pd.DataFrame) -> np.ndarray:
        return stack(t[col]) * (stack(t[mask]) if mask else 1.0)

    return pair_values(left, right, lambda u, v: shown(u) @ inverse @ shown(v).T)


def gamma_weights(support: DataFrame, time_kernel: np.ndarray, lam: float, lam_gamma: float, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(context x steps, steps): forecasts are a query's context times the first, plus the second.

    With A = (K + lam I)^-1, g (G + lam_gamma I)^-1 Y is q A (X'X A + lam_gamma I)^-1 X'Y, so the support
    comes in by sums of outer products only, over the rows observed at a step: no task holds more than a
    batch of it, and the driver gets a matrix of the context's size a step, or one in all where every target
    is observed."""
    n = len(time_kernel)
    masked = "y_mask" in support.columns and not support.where(F.exists("y_mask", lambda m: m <= 0)).isEmpty()

    def outer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        products, targets, seen = {}, 0.0, 0.0
        for part in parts:
            if not len(part):
                continue
            x, y = stack(part["x"]), stack(part["y"])
            shown = stack(part["y_mask"]) > 0 if masked else np.ones((len(x), 1), bool)
            # steps that the batch's rows observe alike share a product
            patterns, which = np.unique(shown, axis=1, return_inverse=True)
            made = [x[patterns[:, p]].T @ x[patterns[:, p]] for p in range(patterns.shape[1])]
            for h, p in enumerate(which.ravel()):
                products[h] = products.get(h, 0.0) + made[p]
            targets, seen = targets + x.T @ np.where(shown, y, 0.0), seen + shown.sum(0)
        if products:
            rows = [*products.items(), (len(products), targets), (len(products) + 1, seen)]
            yield pd.DataFrame({"g": [g for g, _ in rows], "m": [np.asarray(m, "<f8").tobytes() for _, m in rows]})

    sums = [m for _, m in partial_sums(support.mapInPandas(outer, "g long, m binary"))]
    if not sums:
        raise ValueError("no support")
    products, targets, seen = sums[:-2], sums[-2].reshape(n, -1), sums[-1]
    root = np.linalg.cholesky(np.linalg.inv(time_kernel + lam * np.eye(n)))
    out = np.zeros_like(targets)
    for h in range(targets.shape[1]):
        if h == 0 or len(products) > 1:
            inner = root.T @ products[h].reshape(n, n) @ root + lam_gamma * np.eye(n)
        out[:, h] = root @ np.linalg.solve(inner, root.T @ targets[:, h])
    return out, np.where(np.broadcast_to(seen, targets.shape[1:]) > 0, 0.0, fill)


def predict_gamma(support: DataFrame, queries: DataFrame, time_kernel: np.ndarray, lam: float, lam_gamma: float, fill: float = 0.0) -> DataFrame:
    """k, yhat of queries (k, x) from the support (k, x, y[, y_mask]): g (G + lam_gamma I)^-1 Y.

    With ``y_mask``, each step is solved on the support rows observed there; a step that no row observes gets
    ``fill``.  The support may have any number of rows, see ``gamma_weights``.
    """
    weights, bias = gamma_weights(support, time_kernel, lam, lam_gamma, fill)

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"k": part["k"], "yhat": list(stack(part["x"]) @ weights + bias)})

    return queries.select("k", "x").mapInPandas(made, f"k {dict(queries.dtypes)['k']}, yhat array<double>")
