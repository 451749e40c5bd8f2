"""Kernels between series.  A kernel is an immutable value: ``fitted`` returns one with estimated
parameters, ``gram`` a DataFrame (i, j, value), ``matrix`` the dense block of one tile.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernelloom.catalog import DEFAULTS
from kernelloom.operators import decompose, pairwise
from kernelloom.operators.pairwise import aligned_patches, by_place, masked_squared_distances, patches, squared_distances, stack
from kernelloom.staging import cut


#: Largest exponent whose terms single precision holds to about 4e-6.
SINGLE_TERM = 64


def positive_median(d: np.ndarray) -> float:
    """Median of positive finite values, 1 without any."""
    d = d[np.isfinite(d) & (d > 0)]
    return float(np.median(d)) if len(d) else 1.0


def drawn(rows: DataFrame, n: int, seed: int = 0, key: str = "k") -> pd.DataFrame:
    """At most n rows, those of the smallest hash of key and seed: a bounded sample that reruns repeat."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).toPandas().sort_values(key, ignore_index=True)


def _upper(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m), 1)]


@dataclass(frozen=True)
class Kernel(ABC):
    """``points`` bounds the rows from which parameters are estimated."""

    @abstractmethod
    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        """Kernel values of the rows of u with those of v; series are in column ``x``."""

    #: Whether ``between`` can save time by single precision.
    has_single = False

    def between(self, u: pd.DataFrame, v: pd.DataFrame, single: bool = False) -> Callable[[slice, slice], np.ndarray]:
        """The matrix of two slices of u's and v's rows; ``single``: near it, in single precision, if the kernel can."""
        return lambda p, q: self.matrix(u.iloc[p], v.iloc[q])

    def products(self, u: pd.DataFrame, v: pd.DataFrame, col: str, single: bool = False, block: int = pairwise.BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(K v's ``col``, K' u's ``col``) of K, the matrix of u and v, of which one tile is held at a time."""
        kind = np.float32 if single else float
        a, b = (stack(t[col]).astype(kind) for t in (u, v))
        left, right, tile = np.zeros((len(u), b.shape[1])), np.zeros((len(v), a.shape[1])), self.between(u, v, single)
        for p in (slice(i, i + block) for i in range(0, len(u), block)):
            for q in (slice(i, i + block) for i in range(0, len(v), block)):
                m = tile(p, q)
                left[p] += m @ b[q]
                if u is not v:
                    right[q] += m.T @ a[p]
        return left.astype(kind), right.astype(kind)

    def fitted(self, rows: DataFrame, seed: int = 0) -> "Kernel":
        return self.estimated(drawn(rows, getattr(self, "points", 24), seed))

    def estimated(self, sample: pd.DataFrame) -> "Kernel":
        return self

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` with what ``matrix`` of ``tiled`` needs of each series, made once however many tiles read it."""
        return rows

    def tiled(self) -> "Kernel":
        """The kernel of ``staged`` rows: every task of a tile gets it, so it holds nothing large."""
        return self

    def gram(self, left: DataFrame, right: DataFrame | None = None, block: int = pairwise.BLOCK) -> DataFrame:
        return pairwise.pair_values(self.staged(left), None if right is None else self.staged(right), self.tiled().matrix, block=block)


def _known(value: float | None, name: str) -> float:
    if value is None:
        raise ValueError(f"{name} isn't set: use fitted()")
    return value


def own_scale(kernel: Kernel) -> float | None:
    """The kernel's length scale or width, if it has one."""
    return next((float(s) for n in ("lengthscale", "sigma") if (s := getattr(kernel, n, None)) is not None), None)


def group_scales(rows: DataFrame, kernels: dict[str, Kernel], by: str, seed: int = 0) -> DataFrame:
    """(by, kernel, scale): each group's estimates of each kernel, made in tasks on the group's ``points`` rows of
    the smallest hash."""
    most = max(getattr(k, "points", 24) for k in kernels.values())
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("k", F.lit(seed)), "k"))
    some = rows.withColumn("_r", rank).where(F.col("_r") <= most)

    def estimate(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_r", ignore_index=True)
        made = [own_scale(k.estimated(part.iloc[: getattr(k, "points", 24)])) for k in kernels.values()]
        return pd.DataFrame({by: key[0], "kernel": list(kernels), "scale": made})

    return some.groupBy(by).applyInPandas(estimate, f"{by} {dict(rows.dtypes)[by]}, kernel string, scale double")


@dataclass(frozen=True)
class RBF(Kernel):
    """exp(-d^2 / 2 l^2); l is the median of positive distances."""

    lengthscale: float | None = None
    points: int = DEFAULTS.pairwise_median_subset

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        return np.exp(-squared_distances(stack(u["x"]), stack(v["x"])) / (2 * _known(self.lengthscale, "lengthscale") ** 2))

    has_single = True

    def between(self, u: pd.DataFrame, v: pd.DataFrame, single: bool = False) -> Callable[[slice, slice], np.ndarray]:
        twice = 2 * _known(self.lengthscale, "lengthscale") ** 2
        a = stack(u["x"])
        b = a if u is v else stack(v["x"])
        if not single:
            return lambda p, q: np.exp(-squared_distances(a[p], b[q]) / twice)
        # -|a - b|^2 as one product of matrices, 2 a'b - |a|^2 1 - 1 |b|^2, about a common centre
        centre = a.mean(0)
        a, b = a - centre, b - centre
        own = lambda x: (x * x).sum(1)[:, None] / -twice
        left = np.hstack([a * (2 / twice), own(a), np.ones((len(a), 1))])
        right = np.hstack([b, np.ones((len(b), 1)), own(b)])
        # where the terms are large, their differences need double precision
        kind = np.float32 if max(-left[:, -2].min(initial=0), -right[:, -1].min(initial=0)) < SINGLE_TERM else float
        left, right = left.astype(kind), right.astype(kind)

        def tile(p: slice, q: slice) -> np.ndarray:
            m = left[p] @ right[q].T
            return np.exp(m, out=m)

        return tile

    def estimated(self, sample: pd.DataFrame) -> "RBF":
        if self.lengthscale is not None:
            return self
        x = stack(sample["x"])
        return replace(self, lengthscale=positive_median(np.sqrt(_upper(squared_distances(x, x)))) if len(x) > 1 else 1.0)


@dataclass(frozen=True)
class MaskedRBF(Kernel):
    """exp(-[D / (2 r) + lam (d - r)] / l^2) with D and r over positions that both masks (column ``mask``,
    else the non-zero positions) observe; 0 for a pair that shares none."""

    lengthscale: float | None = None
    lam: float = 0.01
    points: int = DEFAULTS.pairwise_median_subset

    @staticmethod
    def _parts(u: pd.DataFrame, v: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        a, b = stack(u["x"]), stack(v["x"])
        pa, pb = (stack(t["mask"]) if "mask" in t else (x != 0).astype(float) for t, x in ((u, a), (v, b)))
        return *masked_squared_distances(a, b, pa, pb), a.shape[1]

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        d2, r, d = self._parts(u, v)
        value = np.exp(-(d2 / (2 * np.where(r > 0, r, 1)) + self.lam * (d - r)) / _known(self.lengthscale, "lengthscale") ** 2)
        return np.where(r > 0, value, 0.0)

    def estimated(self, sample: pd.DataFrame) -> "MaskedRBF":
        if self.lengthscale is not None:
            return self
        d2, r, _ = self._parts(sample, sample)
        return replace(self, lengthscale=positive_median(_upper(np.sqrt(d2 / np.where(r > 0, r, 1)))))


@dataclass(frozen=True)
class Linear(Kernel):
    bias: float = 0.0

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        return stack(u["x"]) @ stack(v["x"]).T + self.bias


@dataclass(frozen=True)
class NTK(Kernel):
    """The neural tangent kernel of a ReLU network of ``depth`` layers, by its recursion over (x.y, |x|^2,
    |y|^2); with ``normalize`` as a correlation."""

    depth: int = 3
    sigma_w: float = 2**0.5
    sigma_b: float = 0.0
    normalize: bool = True

    def _own(self, x: np.ndarray) -> np.ndarray:
        s = self.sigma_w**2 * (x * x).sum(1) / x.shape[1] + self.sigma_b**2
        theta = s
        for _ in range(self.depth):
            s = self.sigma_w**2 * s / 2 + self.sigma_b**2
            theta = s + self.sigma_w**2 * 0.5 * theta
        return theta

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        a, b = stack(u["x"]), stack(v["x"])
        w, c, d = self.sigma_w**2, self.sigma_b**2, a.shape[1]
        cross = w * (a @ b.T) / d + c
        sa, sb = (w * (x * x).sum(1) / d + c for x in (a, b))
        theta = cross
        for _ in range(self.depth):
            norm = np.sqrt(np.maximum(sa[:, None] * sb[None], 1e-30))
            rho = np.clip(cross / norm, -1.0, 1.0)
            angle = np.pi - np.arccos(rho)
            cross = w * norm * (np.sqrt(1 - rho**2) + angle * rho) / (2 * np.pi) + c
            theta = cross + w * theta * angle / (2 * np.pi)
            sa, sb = w * sa / 2 + c, w * sb / 2 + c
        if not self.normalize:
            return theta
        return theta / np.sqrt(np.maximum(self._own(a)[:, None] * self._own(b)[None], 1e-30))


@dataclass(frozen=True)
class DTW(Kernel):
    """exp(-D^2 / 2 s^2) of the warping distance D; s is the median of positive distances."""

    sigma: float | None = None
    window: int | None = None
    points: int = DEFAULTS.pairwise_median_subset

    def distances(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        return pairwise.dtw_matrix(self.window)(u, v)

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        return np.exp(-self.distances(u, v) ** 2 / (2 * _known(self.sigma, "sigma") ** 2))

    def estimated(self, sample: pd.DataFrame) -> "DTW":
        return self if self.sigma is not None else replace(self, sigma=positive_median(_upper(self.distances(sample, sample))))


@dataclass(frozen=True)
class Wavelet(Kernel):
    """On continuous wavelet transforms: ``energy`` and ``coeffs`` are RBFs of the energies by scale and of
    the coefficients; ``inner`` is their weighted inner product over the shared length, as a correlation by
    each side's own norm."""

    mode: str = "energy"
    sigma: float | None = None
    n_scales: int = 8
    scale_min: float = 1.0
    scale_max: float | None = None
    wavelet: str = "ricker"
    weights: tuple[float, ...] | None = None
    top_k: int | None = None
    points: int = DEFAULTS.pairwise_median_subset

    def _transformed(self, x) -> np.ndarray:
        made = decompose.cwt(np.asarray(x, float), self.wavelet, self.n_scales, self.scale_min, self.scale_max, top_k=self.top_k)
        return made.energies if self.mode == "energy" else made.coeffs

    def _features(self, t: pd.DataFrame) -> list[np.ndarray]:
        """A row of energies, or coefficients by scale, for each series: stored ones, or made here."""
        if "f" not in t:
            return [self._transformed(x) for x in t["x"]]
        scales = self.n_scales if self.top_k is None else min(self.top_k, self.n_scales)
        return [np.asarray(f, float) if self.mode == "energy" else np.asarray(f, float).reshape(scales, -1) for f in t["f"]]

    def staged(self, rows: DataFrame) -> DataFrame:
        own = self._transformed

        @F.pandas_udf("array<double>")
        def made(x: pd.Series) -> pd.Series:
            return pd.Series([own(v).ravel() for v in x])

        return cut(rows.withColumn("f", made("x")))

    def _distances(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        flat = lambda t: np.array([f.ravel() for f in self._features(t)])
        return np.sqrt(squared_distances(flat(u), flat(v)))

    def _products(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Weighted inner products over the shared length: one product of matrices for each pair of lengths."""
        w = np.ones(len(a[0])) if self.weights is None else np.asarray(self.weights)
        out = np.empty((len(a), len(b)))
        lengths = [np.array([f.shape[1] for f in fs]) for fs in (a, b)]
        for n in np.unique(lengths[0]):
            for m in np.unique(lengths[1]):
                i, j = np.flatnonzero(lengths[0] == n), np.flatnonzero(lengths[1] == m)
                p, q = (np.stack([fs[r][:, : min(n, m)] for r in own]) for fs, own in ((a, i), (b, j)))
                out[np.ix_(i, j)] = (p * w[:, None]).reshape(len(i), -1) @ q.reshape(len(j), -1).T
        return out

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        if self.mode in ("energy", "coeffs"):
            return np.exp(-self._distances(u, v) ** 2 / (2 * _known(self.sigma, "sigma") ** 2))
        if self.mode != "inner":
            raise ValueError(f"no mode named {self.mode!r}")
        a, b = self._features(u), self._features(v)
        w = np.ones(len(a[0])) if self.weights is None else np.asarray(self.weights)
        own = lambda fs: np.array([np.sqrt(n) if (n := float((w[:, None] * f * f).sum())) > 1e-12 else 1.0 for f in fs])
        return self._products(a, b) / own(a)[:, None] / own(b)[None]

    def estimated(self, sample: pd.DataFrame) -> "Wavelet":
        if self.sigma is not None or self.mode == "inner":
            return self
        return replace(self, sigma=positive_median(_upper(self._distances(sample, sample))))


def _turned(self, outer: np.ndarray, count: int):
    """The kernel whose projection is the gradients' mean outer product, with the round's own length scale."""
    m = outer / count
    norm = np.linalg.norm(m)
    return replace(self, projection=tuple(map(tuple, m / norm if self.normalize and norm > 0 else m)))


def _learnt(self, train: pd.DataFrame, y: np.ndarray, gamma: float):
    """A projection learnt within one task: each round estimates the length scale anew, solves, and turns."""
    kernel = self.started(train)
    for _ in range(self.rounds):
        kernel = kernel.estimated(train.iloc[: self.points])
        g = kernel.matrix(train, train)
        a = np.linalg.solve(g + gamma * np.eye(len(g)), y).sum(1)
        kernel = kernel.turned(*kernel.gradient_outer(kernel.gradient_parts(train, train, a), train))
    return kernel


@dataclass(frozen=True)
class FeatureMachine(Kernel):
    """An RBF on M x, where M is learnt from the fit's own gradients (a recursive feature machine)."""

    rounds: int = 3
    lengthscale: float | None = None
    normalize: bool = True
    projection: tuple[tuple[float, ...], ...] | None = None
    points: int = DEFAULTS.pairwise_median_subset

    def _project(self, t: pd.DataFrame) -> np.ndarray:
        x = stack(t["x"])
        return x if self.projection is None else x @ np.array(self.projection).T

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        return np.exp(-squared_distances(self._project(u), self._project(v)) / (2 * _known(self.lengthscale, "lengthscale") ** 2))

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` with M x for x."""
        own = self._project

        @F.pandas_udf("array<double>")
        def made(x: pd.Series) -> pd.Series:
            return pd.Series(list(own(x.to_frame("x"))) if len(x) else [])

        return rows if self.projection is None else cut(rows.withColumn("x", made("x")))

    def tiled(self) -> RBF:
        """Without M, of which each round of a solve would else leave a copy with the driver."""
        return RBF(self.lengthscale)

    def estimated(self, sample: pd.DataFrame) -> "FeatureMachine":
        x = self._project(sample)
        return replace(self, lengthscale=positive_median(np.sqrt(_upper(squared_distances(x, x)))))

    def started(self, sample: pd.DataFrame) -> "FeatureMachine":
        return replace(self, projection=tuple(map(tuple, np.eye(len(sample["x"].iloc[0])))))

    def gradient_parts(self, u: pd.DataFrame, v: pd.DataFrame, a: np.ndarray) -> list[np.ndarray]:
        """For each row of u, what v's rows with summed coefficients a add to its gradient: with
        W_ij = G_ij a_j, (W X)_i and (W 1)_i, since the sum of W_ij (x_j - x_i) is (W X)_i - (W 1)_i x_i."""
        w = self.matrix(u, v) * a[None]
        return list(np.hstack([w @ stack(v["x"]), w.sum(1)[:, None]]))

    def gradient_outer(self, parts: list[np.ndarray], rows: pd.DataFrame) -> tuple[np.ndarray, int]:
        """(sum of the gradients' outer products, their number)."""
        p, m = stack(parts), np.array(self.projection)
        grad = (p[:, :-1] - p[:, -1:] * stack(rows["x"])) @ (m.T @ m).T / (2 * self.lengthscale**2)
        return grad.T @ grad, len(grad)

    turned = _turned
    learnt = _learnt


@dataclass(frozen=True)
class PatchMachine(Kernel):
    """Sums of RBFs over aligned patches of width q projected by a learnt q x q matrix; its size doesn't
    depend on the series' length."""

    q: int = 32
    stride: int = 1
    rounds: int = 3
    lengthscale: float | None = None
    normalize: bool = True
    projection: tuple[tuple[float, ...], ...] | None = None
    points: int = 20

    def _patches(self, t: pd.DataFrame) -> list[np.ndarray]:
        return [patches(np.asarray(x, float), self.q, self.stride) for x in t["x"]]

    def _m(self) -> np.ndarray | None:
        return None if self.projection is None else np.array(self.projection)

    def matrix(self, u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        return aligned_patches(self._patches(u), self._patches(v), self._m(), _known(self.lengthscale, "lengthscale"))

    def estimated(self, sample: pd.DataFrame) -> "PatchMachine":
        own, m = self._patches(sample.iloc[: self.points]), self._m()
        found = []
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                n = min(len(own[i]), len(own[j]))
                d = own[i][:n] - own[j][:n]
                found.append(np.sqrt(((d if m is None else d @ m.T) ** 2).sum(1)))
        return replace(self, lengthscale=positive_median(np.concatenate(found) if found else np.zeros(0)))

    def started(self, sample: pd.DataFrame) -> "PatchMachine":
        return replace(self, projection=tuple(map(tuple, np.eye(self.q))))

    def gradient_parts(self, u: pd.DataFrame, v: pd.DataFrame, a: np.ndarray) -> list[np.ndarray]:
        """As ``FeatureMachine.gradient_parts``, for each of a row's projected patches in turn."""
        m, left, right = self._m(), self._patches(u), self._patches(v)
        out = [np.zeros((len(p), self.q + 1)) for p in left]
        for at in range(max(map(len, left), default=0)):
            (i, p), (j, q) = by_place(left, at), by_place(right, at)
            if not len(i) or not len(j):
                continue
            p, q = p @ m.T, q @ m.T
            w = np.exp(-squared_distances(p, q) / (2 * self.lengthscale**2)) * a[j][None]
            for r, row in zip(i, np.hstack([w @ q, w.sum(1)[:, None]])):
                out[r][at] = row
        return [o.ravel() for o in out]

    def gradient_outer(self, parts: list[np.ndarray], rows: pd.DataFrame) -> tuple[np.ndarray, int]:
        """The gradients have no factor of the length scale."""
        m = self._m()
        p = np.concatenate([np.asarray(x, float).reshape(-1, self.q + 1) for x in parts])
        grad = (p[:, :-1] - p[:, -1:] * (np.concatenate(self._patches(rows)) @ m.T)) @ m
        return grad.T @ grad, len(grad)

    turned = _turned
    learnt = _learnt
