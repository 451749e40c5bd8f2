"""Training, evaluation and sweeps over prepared examples (k, history, future, mu, sigma, future_n, x)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelloom.catalog import DEFAULTS
from kernelloom.functions.draws import drawn as draw
from kernelloom.functions.series import unscaled
from kernelloom.operators.augment import prepare_examples, uniform_length
from kernelloom.operators.kernels import FeatureMachine, Kernel, PatchMachine, drawn, own_scale
from kernelloom.operators.metrics import scored, summary
from kernelloom.operators.pairwise import UnequalLengths, block_sums, fresh, partial_sums, stack
from kernelloom.operators.slicing import numbered
from kernelloom.operators.solve import MAX_DENSE, conjugate_gradients, fit_dense, predict, ridge
from kernelloom.staging import cut

#: Kernels that learn a projection from the fit.
LEARNT = (FeatureMachine, PatchMachine)


@dataclass(frozen=True)
class Result:
    kernel: Kernel
    gamma: float
    model: DataFrame
    predictions: DataFrame

    def summary(self) -> DataFrame:
        return summary(self.predictions)


def fit(train: DataFrame, kernel: Kernel, gamma: float = DEFAULTS.gamma, seed: int = DEFAULTS.random_seed, max_rows: int = MAX_DENSE) -> tuple[DataFrame, Kernel]:
    """(train with alpha, the fitted kernel): dense up to ``max_rows`` rows, else conjugate gradients.

    The model is cut, so it is solved once however often it is read.
    """
    n = train.count()
    kernel = learn(train, n, kernel, gamma, seed, max_rows) if isinstance(kernel, LEARNT) else kernel.fitted(train, seed)
    return solved(train, n, kernel, gamma, max_rows), kernel


def solved(train: DataFrame, n: int, kernel: Kernel, gamma: float, max_rows: int = MAX_DENSE) -> DataFrame:
    return cut((fit_dense if n <= max_rows else conjugate_gradients)(train, kernel, gamma))


def learn(train: DataFrame, n: int, kernel: FeatureMachine | PatchMachine, gamma: float, seed: int = DEFAULTS.random_seed, max_rows: int = MAX_DENSE) -> FeatureMachine | PatchMachine:
    """A feature machine's projection from all training rows: each round's solve is a task's or goes by
    conjugate gradients, the gradients are summed over tiles, and only their outer products' sum, of the
    projection's size, comes to the driver.  Length scales are estimated on ``points`` rows, as by other kernels."""
    sample = drawn(train, kernel.points, seed)
    kernel = kernel.started(sample)
    for _ in range(kernel.rounds):
        kernel = kernel.estimated(sample)
        model = solved(train, n, kernel, gamma, max_rows)

        def parts(u: pd.DataFrame, v: pd.DataFrame, now: Kernel = kernel) -> list[np.ndarray]:
            return now.gradient_parts(u, v, stack(v["alpha"]).sum(1))

        def outer(batches: Iterator[pd.DataFrame], now: Kernel = kernel) -> Iterator[pd.DataFrame]:
            total, count = 0.0, 0
            for batch in batches:
                if len(batch):
                    m, c = now.gradient_outer(list(batch["g"]), batch)
                    total, count = total + m, count + c
            if count:
                yield pd.DataFrame({"g": [0], "m": [np.append(total.ravel(), count).astype("<f8").tobytes()]})

        sums = block_sums(train.select("k", "x"), model.select("k", "x", "alpha"), parts, "g", rows=(n, n))
        made = partial_sums(train.select("k", "x").join(sums, "k").mapInPandas(outer, "g long, m binary"))[0][1]
        size = int(np.sqrt(len(made) - 1))
        kernel = kernel.turned(made[:-1].reshape(size, size), int(made[-1]))
    return kernel


def masks_or_zeros(examples: DataFrame) -> DataFrame:
    """``examples`` without the column ``mask`` unless all rows have one: a kernel with masks then goes by the
    non-zero positions."""
    if "mask" not in examples.columns:
        return examples
    return examples if examples.where("mask is null").isEmpty() else examples.drop("mask")


def mask_sparsity(examples: DataFrame, *by: str) -> DataFrame:
    """all_masked, and the share of positions that the masks hide (null without any)."""
    long = examples.select(*by, F.col("mask").isNotNull().alias("_has"), F.explode_outer("mask").alias("_m"))
    return long.groupBy(*by).agg(F.bool_and("_has").alias("all_masked"), (1 - F.avg("_m")).alias("sparsity"))


def modelled(prepared: DataFrame, x: str = "x_model") -> DataFrame:
    """k, x, y[, mask] for the fit, with what scoring needs."""
    extra = ["mask"] if "mask" in prepared.columns else []
    return prepared.select("k", F.col(x).alias("x"), F.col("future_n").alias("y"), *extra)


def train_eval(train: DataFrame, test: DataFrame, kernel: Kernel, gamma: float = DEFAULTS.gamma, seed: int = DEFAULTS.random_seed) -> Result:
    """Fit on ``train``, predict ``test`` in one cross-kernel, score on the original scale.  Both sides are
    read several times, so they are cut first."""
    train, test = cut(train), cut(test)
    model, kernel = fit(modelled(train), kernel, gamma, seed)
    yhat = predict(model, modelled(test).drop("y"), kernel)
    rows = test.join(yhat, "k").withColumn("future_pred", unscaled(F.col("yhat"), F.col("mu"), F.col("sigma")))
    return Result(kernel, gamma, model, scored(rows))


def split_random(examples: DataFrame, n_test: int = DEFAULTS.n_test_samples, seed: int = DEFAULTS.random_seed, key: str = "k") -> tuple[DataFrame, DataFrame]:
    """(train, test): the ``n_test`` rows of the smallest draw by seed and key are the test set."""
    n = examples.count()
    if n <= n_test:
        raise ValueError(f"{n} examples leave none to train on after {n_test} test rows")
    test = examples.select(key).orderBy(draw(F.lit(seed), F.col(key)), key).limit(n_test)
    return examples.join(test, key, "left_anti"), examples.join(test, key, "left_semi")


def split_by_keys(examples: DataFrame, test: DataFrame | None = None, train: DataFrame | None = None, key: str = "k") -> tuple[DataFrame, DataFrame]:
    """(train, test) from the keys of one or both; the other is the complement.  Unknown keys raise."""
    for given in (train, test):
        if given is not None and not given.select(key).join(examples.select(key), key, "left_anti").isEmpty():
            raise IndexError("a key of the split isn't among the examples")
    if test is None and train is None:
        raise ValueError("name the test keys, the training keys or both")
    pick = lambda keys: examples.join(keys.select(key).distinct(), key, "left_semi")
    rest = lambda keys: examples.join(keys.select(key).distinct(), key, "left_anti")
    return rest(test) if train is None else pick(train), rest(train) if test is None else pick(test)


def pretrain_eval(chunks: DataFrame, examples: DataFrame, kernel: Kernel, gamma: float = DEFAULTS.gamma, length: int = 512, future_len: int = 64, seed: int = DEFAULTS.random_seed) -> Result:
    """A model trained on chunks of pretraining series (sample_idx, history, future) and scored on examples of
    another collection: both cropped or padded to one length, prepared alike, then ``train_eval``."""
    ready = lambda df: prepare_examples(uniform_length(df, length, future_len, seed=seed)).withColumn("k", F.col("sample_idx"))
    return train_eval(ready(chunks), ready(examples), kernel, gamma, seed)


@dataclass(frozen=True)
class Sweep:
    """Predictions of all domains that have a model, and (domain, reason) of the others."""

    predictions: DataFrame
    failed: DataFrame


def run_all_domains(train: DataFrame, test: DataFrame, kernel: Kernel, gamma: float = DEFAULTS.gamma, domain: str = "domain", **options) -> DataFrame:
    """The predictions of ``sweep_domains``."""
    return sweep_domains(train, test, kernel, gamma, domain, **options).predictions


def sweep_domains(train: DataFrame, test: DataFrame, kernel: Kernel, gamma: float = DEFAULTS.gamma, domain: str = "domain", max_rows: int = MAX_DENSE, length: int | None = None, future_len: int | None = None, seed: int = DEFAULTS.random_seed) -> Sweep:
    """Test rows with future_pred, scores, and their model's kernel, n_train, lengthscale and gamma: one
    independent model a domain, and the domains without one.

    Domains of up to ``max_rows`` training rows are a task's work each, all in parallel; a larger one is a
    job of its own over tiles (``fit``), one after another.  Each domain estimates its own parameters on its
    ``points`` rows of the smallest hash, and feature machines learn its projection.  Masks count as in
    ``masks_or_zeros``.  With ``length``, prepared rows are cropped or padded to it first.

    A domain without training or test rows, with series of unequal length or a singular system fails, with
    that reason, and leaves the others alone; any other error is raised.
    """
    if length is not None:
        train, test = (prepare_examples(uniform_length(df, length, future_len, seed=seed)) for df in (train, test))
    train, test = cut(train), cut(test)
    large = sorted(r[0] for r in train.groupBy(domain).count().where(F.col("count") > max_rows).collect() if r[0] is not None)
    kinds = dict(test.dtypes)
    masked = all("mask" in masks_or_zeros(df).columns for df in (train, test))
    extra = ["mask"] if masked else []
    small = lambda df: df.where(~F.coalesce(F.col(domain).isin(large), F.lit(False))) if large else df
    a = small(train).select(domain, "k", F.col("x_model").alias("x"), F.col("future_n").alias("y"), F.xxhash64("k", F.lit(seed)).alias("_h"), *extra)
    b = small(test).select(domain, "k", F.col("x_model").alias("x"), *extra)
    columns = [domain, "k", "yhat", "n_train", "lengthscale", "reason"]

    def one(key: tuple, u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        reason = "no training rows" if not len(u) else "no test rows" if not len(v) else None
        if reason is None:
            try:
                # the rows that parameters are estimated on come first
                u = u.sort_values(["_h", "k"], ignore_index=True)
                first, y = u.iloc[: getattr(kernel, "points", 24)], stack(u["y"])
                own = kernel.learnt(u, y, gamma) if isinstance(kernel, LEARNT) else kernel.estimated(first)
                yhat = own.matrix(v, u) @ ridge(own.matrix(u, u), y, gamma)
                return pd.DataFrame({domain: v[domain], "k": v["k"], "yhat": list(yhat), "n_train": len(u), "lengthscale": own_scale(own), "reason": None})
            except (np.linalg.LinAlgError, UnequalLengths) as e:
                reason = f"{type(e).__name__}: {e}"
        return pd.DataFrame([[key[0], None, None, None, None, reason]], columns=columns, dtype=object)

    schema = f"{domain} {kinds[domain]}, k {kinds['k']}, yhat array<double>, n_train long, lengthscale double, reason string"
    made = cut(a.groupBy(domain).cogroup(fresh(b).groupBy(domain)).applyInPandas(one, schema))
    failed, made = made.where("reason is not null").select(domain, "reason"), made.where("reason is null").drop("reason")
    for name in large:
        mine, theirs = (df.where(F.col(domain) == name).drop(*([] if masked else ["mask"])) for df in (train, test))
        if theirs.isEmpty():
            failed = failed.unionByName(mine.limit(1).select(domain, F.lit("no test rows").alias("reason")))
            continue
        n = mine.count()
        model, own = fit(modelled(mine), kernel, gamma, seed, max_rows)
        yhat = predict(model, modelled(theirs).drop("y"), own).join(theirs.select("k", domain), "k")
        made = made.unionByName(yhat.withColumns({"n_train": F.lit(n).cast("long"), "lengthscale": F.lit(own_scale(own)).cast("double")}).select(columns[:-1]))
    rows = test.join(made, [domain, "k"]).withColumn("future_pred", unscaled(F.col("yhat"), F.col("mu"), F.col("sigma")))
    return Sweep(scored(rows).withColumns({"kernel": F.lit(type(kernel).__name__), "gamma": F.lit(float(gamma))}), failed)


def study_sizes(most: int, sizes: list[int] | None = None, least: int = 5, count: int = 8, max_gram: int | None = 500_000) -> list[int]:
    """Training sizes: given ones, else log-spaced from ``least``; clamped, distinct, ascending, and with
    the Gram matrix within ``max_gram`` elements."""
    found = sizes if sizes is not None else np.geomspace(min(least, most), most, count).astype(int).tolist()
    return sorted({s for s in (min(int(s), most) for s in found) if s > 0 and (max_gram is None or s * s <= max_gram)})


def scaling_study(train: DataFrame, test: DataFrame, kernel: Kernel, gamma: float = DEFAULTS.gamma, sizes: list[int] | None = None, seed: int | None = None) -> DataFrame:
    """n_train, k, future_pred and scores: one model a size, all fitted in parallel on a fixed test set.

    The training sets are nested: the first rows by key, or by a hash of key and seed.
    """
    most = train.count()
    wanted = study_sizes(most, sizes)
    if not wanted:
        raise ValueError("no training size is left")
    order = F.lit(0) if seed is None else F.xxhash64("k", F.lit(seed))
    rank = numbered(train.select("k", order.alias("_o")), "_o", "k", name="_r").where(F.col("_r") < wanted[-1]).select("k", "_r")
    rows = train.join(rank, "k").withColumn("n_train", F.explode(F.array(*map(F.lit, wanted)))).where("_r < n_train").drop("_r")
    tests = test.withColumn("n_train", F.explode(F.array(*map(F.lit, wanted))))
    rows, tests = (df.withColumnRenamed("n_train", "n_wanted") for df in (rows, tests))
    return run_all_domains(rows, tests, kernel, gamma, "n_wanted").drop("n_wanted")
