"""Regularised kernel systems: dense solves in grouped tasks, preconditioned conjugate gradients over tiles beyond."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelloom.operators.kernels import Kernel, drawn
from kernelloom.operators.pairwise import Dealt, block_sums, partial_sums, stack
from kernelloom.staging import cut, few_partitions

#: Rows of one dense system; a larger training set goes to ``conjugate_gradients``.
MAX_DENSE = 4096
#: From how many rows on rounds may go by single precision, and how far such rounds lessen a residual.
SINGLE_ROWS, SINGLE_GAIN = 4096, 1e-4


def ridge(g: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.linalg.solve(g + gamma * np.eye(len(g)), y)


def fit_dense(train: DataFrame, kernel: Kernel, gamma: float, group: str | None = None, max_rows: int = MAX_DENSE) -> DataFrame:
    """``train`` (k, x, y[, mask]) with alpha, one dense solve a group; groups run in parallel.

    A group of more than ``max_rows`` rows raises ValueError before any task gathers it.
    """
    rows = train if group else train.withColumn("_all", F.lit(0))
    by = group or "_all"
    top = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if top > max_rows:
        raise ValueError(f"{top} rows in one dense system, at most {max_rows}: use conjugate_gradients")
    names = [f"{n} {t}" for n, t in rows.dtypes if n != "_all"]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", ignore_index=True)
        part["alpha"] = list(ridge(kernel.matrix(part, part), stack(part["y"]), gamma))
        return part.drop(columns="_all", errors="ignore")

    return rows.groupBy(by).applyInPandas(solve, ", ".join([*names, "alpha array<double>"]))


def predict(model: DataFrame, query: DataFrame, kernel: Kernel, block: int = 1024) -> DataFrame:
    """k, yhat: cross-kernel times alpha in tiles, each tile's partial products summed."""
    needed = [c for c in ("k", "x", "mask") if c in query.columns]
    model = kernel.staged(model.select(*[c for c in ("k", "x", "mask") if c in model.columns], "alpha"))
    query, kernel = kernel.staged(query.select(needed)), kernel.tiled()
    return block_sums(query, model, lambda u, v: kernel.matrix(u, v) @ stack(v["alpha"]), "yhat", block=block)


def landmark_panel(rows: DataFrame, kernel: Kernel, sample: pd.DataFrame) -> tuple[DataFrame, int]:
    """(k, b) of all rows and the length of b: kernel values with the sample, through the inverse root of the
    sample's own Gram matrix, directions of no weight left out.  With B of these rows, B B' is the kernel's part
    that the sample spans (Nyström), and B B' + gamma I the preconditioner."""
    g = kernel.matrix(sample, sample)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    keep = values > 1e-10 * values.max()
    turn = vectors[:, keep] / np.sqrt(values[keep])

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"k": part["k"], "b": list(kernel.matrix(part, sample) @ turn)})

    return rows.mapInPandas(made, f"k {dict(rows.dtypes)['k']}, b array<double>"), int(keep.sum())


def _sums(rows: DataFrame, parts: Callable[[pd.DataFrame], list[np.ndarray]]) -> list[np.ndarray]:
    """Element-wise sums over all rows of what ``parts`` makes of each batch."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                made = parts(batch)
                total = made if total is None else [a + b for a, b in zip(total, made)]
        if total is not None:
            yield pd.DataFrame({"g": range(len(total)), "m": [t.astype("<f8").tobytes() for t in total]})

    return [m for _, m in partial_sums(rows.mapInPandas(one, "g long, m binary"))]


def conjugate_gradients(train: DataFrame, kernel: Kernel, gamma: float, tolerance: float = 1e-9, rounds: int | None = None, block: int = 1024, landmarks: int = 512, seed: int = 0) -> DataFrame:
    """``train`` (k, x, y[, mask]) with alpha, without any task holding more than a tile of the system.

    All right-hand sides advance together, each with its own step length, in the form that needs both inner
    products of a round at one time.  Series are dealt to blocks once and kept; only vectors travel.
    At most ``landmarks`` rows precondition the system; the driver holds their Gram matrix.  Each round's vectors are cut, so a lost executor repeats one round at most.  They are kept
    too, which gives the planner their real size: a cut frame's size is an estimate that multiplies both sides of
    each join, and a round's would be the square of the last one's.  A system that
    isn't solved to ``tolerance`` after ``rounds`` raises RuntimeError; where they aren't given, they grow with
    the root of the rows, as the rounds that a kernel system needs do.

    From ``SINGLE_ROWS`` rows on, kernels that can make the matrix in single precision, tile by tile, for rounds
    that lessen the residual by ``SINGLE_GAIN`` at most; what is left is taken in double precision, and solved for
    in turn, until that is within ``tolerance``.  Where this doesn't help, the rest goes by double precision.
    """
    train = cut(train)
    n, size = train.agg(F.count("*"), F.max(F.size("y"))).first()
    rounds = max(200, 2 * math.isqrt(n)) if rounds is None else rounds
    with few_partitions(train.sparkSession, n, 8192):
        alpha = _solved(train, n, size, kernel, gamma, tolerance, rounds, block, landmarks, seed)
    return train.join(alpha, "k")


def _solved(train: DataFrame, n: int, size: int, kernel: Kernel, gamma: float, tolerance: float, rounds: int, block: int, landmarks: int, seed: int) -> DataFrame:
    """(k, alpha) of ``conjugate_gradients``."""
    series = kernel.staged(train.select(*[c for c in ("k", "x", "mask") if c in train.columns]))
    kernel = kernel.tiled()
    panel, rank = landmark_panel(series, kernel, drawn(series, landmarks, seed))
    panel = panel.repartition("k").persist(StorageLevel.MEMORY_AND_DISK)
    dealt = Dealt(series, n, block=block, mirrored=True)
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(cut(df).persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    def products(vectors: DataFrame, col: str, single: bool, out: str = "q") -> DataFrame:
        return dealt.sums(vectors.select("k", col), lambda u, v: kernel.products(u, v, col, single, block), out)

    def projected(t: pd.DataFrame) -> list[np.ndarray]:
        r = stack(t["y"])
        return [(r * r).sum(0), stack(t["b"]).T @ r]

    try:
        inner = _sums(panel, lambda t: [stack(t["b"]).T @ stack(t["b"])])[0].reshape(rank, rank) + gamma * np.eye(rank)
        rest, found, single = train.select("k", "y"), None, kernel.has_single and n >= SINGLE_ROWS
        rr, tr = _sums(panel.join(rest, "k"), projected)
        goal, left = tolerance**2 * np.maximum(rr, 1e-300), rounds
        while True:
            wanted = np.maximum(goal, SINGLE_GAIN**2 * rr) if single else goal
            step, took = _rounds(panel, rest, tr.reshape(rank, size), wanted, inner, gamma, max(1, left // 4) if single else left, lambda t: products(t, "u", single), keep, not single)  # noqa: B023
            left, alpha = left - took, step
            if found is not None:
                alpha = alpha.withColumnRenamed("alpha", "_a").join(found, "k").select("k", F.zip_with("alpha", "_a", lambda a, b: a + b).alias("alpha"))
            if not single:
                return cut(alpha)
            found = keep(alpha)
            added = lambda q, a: q + float(gamma) * a
            rest = train.select("k", "y").join(products(found, "alpha", False), "k").join(found, "k").select("k", F.zip_with("y", F.zip_with("q", "alpha", added), lambda y, q: y - q).alias("y"))
            rest, before = keep(rest), rr
            rr, tr = _sums(panel.join(rest, "k"), projected)
            if (rr <= goal).all():
                return found
            single = bool((rr <= np.maximum(goal, before / 100)).all())
            for old in held[:-2]:
                old.unpersist()
    finally:
        dealt.drop()
        panel.unpersist()
        for old in held:
            old.unpersist()


def _rounds(panel: DataFrame, target: DataFrame, tr: np.ndarray, goal: np.ndarray, inner: np.ndarray, gamma: float, rounds: int, products: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], strict: bool = True) -> tuple[DataFrame, int]:
    """((k, alpha), rounds taken): the system solved for ``target`` (k, y) until the squared residuals are within
    ``goal``; after ``rounds`` it raises if ``strict``, else what was reached is returned.

    ``tr`` is B' y, ``inner`` the preconditioner's B' B + gamma I, ``products`` makes (k, q) with K u for q."""
    kind, size, rank = dict(target.dtypes)["k"], len(goal), len(inner)
    names = ("alpha", "r", "p", "s", "u", "w")
    schema = ", ".join([f"k {kind}", *[f"{c} array<double>" for c in names[:-1]]])
    zero = F.transform("y", lambda v: v * 0.0)

    def inner_products(t: pd.DataFrame) -> list[np.ndarray]:
        r, u, w = (stack(t[c]) for c in "ruw")
        return [(r * r).sum(0), (r * u).sum(0), (w * u).sum(0), stack(t["b"]).T @ w]

    ts = np.zeros((rank, size))
    kept: list[DataFrame] = []
    state = panel.join(target, "k").select("k", "b", zero.alias("alpha"), F.col("y").alias("r"), *[zero.alias(c) for c in "psuw"])
    step, ratio, first, before = np.zeros(size), np.zeros(size), None, None
    for turn in range(rounds + 1):
        # with the coefficients of B that the preconditioner takes away
        rest, a, c = np.linalg.solve(inner, tr), step, ratio

        def advance(parts: Iterator[pd.DataFrame], rest: np.ndarray = rest, a: np.ndarray = a, c: np.ndarray = c) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    alpha, r, p, s, u, w = (stack(part[name]) for name in names)
                    p, s = u + c * p, w + c * s
                    alpha, r = alpha + a * p, r - a * s
                    u = (r - stack(part["b"]) @ rest) / gamma
                    yield pd.DataFrame({"k": part["k"], "alpha": list(alpha), "r": list(r), "p": list(p), "s": list(s), "u": list(u)})

        moved = keep(state.mapInPandas(advance, schema))
        # made, kept and summed in one job
        made = moved.join(products(moved), "k").withColumn("w", F.zip_with("q", "u", lambda q, u: q + float(gamma) * u)).drop("q").persist(StorageLevel.MEMORY_AND_DISK)
        state = panel.join(made, "k")
        rr, ru, wu, tw = _sums(state, inner_products)
        for old in kept:
            old.unpersist()
        kept = [moved, made]
        first = np.maximum(rr, 1e-300) if first is None else first
        open_ = rr > goal
        if not open_.any() or turn == rounds and not strict:
            made.unpersist()
            return moved.select("k", "alpha"), turn
        if turn == rounds:
            raise RuntimeError(f"residuals of {np.sqrt((rr / first).max()):.1e} after {rounds} rounds")
        ratio = np.zeros(size) if before is None else np.where(open_, ru / np.where(before[0] != 0, before[0], 1.0), 0.0)
        bend = wu - (0.0 if before is None else np.where(before[1] != 0, ratio * ru / np.where(before[1] != 0, before[1], 1.0), 0.0))
        step = np.where(open_ & (bend > 0), ru / np.where(bend > 0, bend, 1.0), 0.0)
        before = ru, step
        ts = tw.reshape(rank, size) + ratio * ts
        tr = tr - step * ts
    raise RuntimeError("no round was made")
