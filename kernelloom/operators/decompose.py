"""Decompositions of a series into modes: continuous wavelets and empirical modes, as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def morlet(t: np.ndarray, w0: float = 5.0) -> np.ndarray:
    return np.pi**-0.25 * np.exp(1j * w0 * t) * np.exp(-(t**2) / 2)


def ricker(t: np.ndarray) -> np.ndarray:
    return 2 / (np.sqrt(3) * np.pi**0.25) * (1 - t**2) * np.exp(-(t**2) / 2)


WAVELETS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"morlet": morlet, "ricker": ricker}


@dataclass(frozen=True)
class Transform:
    scales: np.ndarray
    coeffs: np.ndarray
    energies: np.ndarray
    modes: np.ndarray

    @property
    def frequencies(self) -> np.ndarray:
        return 1 / self.scales


def scale_grid(n: int, n_scales: int, lo: float, hi: float | None, spacing: str = "geom") -> np.ndarray:
    hi = n / 4 if hi is None else hi
    return np.geomspace(lo, hi, n_scales) if spacing == "geom" else np.linspace(lo, hi, n_scales)


#: Products above which a convolution goes through the frequencies.
DIRECT = 1 << 16


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The full convolution: directly for short ones, else by overlap-add, block after block of the series
    through the Fourier transform, each block about as long as the taps."""
    if len(x) * len(taps) <= DIRECT:
        return np.convolve(x, taps)
    size = 1 << max(12, (2 * len(taps) - 1).bit_length())
    step, real = size - len(taps) + 1, np.isrealobj(taps)
    forward, back = (np.fft.rfft, np.fft.irfft) if real else (np.fft.fft, np.fft.ifft)
    seen = forward(taps, size)
    out = np.zeros(len(x) + len(taps) - 1, float if real else complex)
    for i in range(0, len(x), step):
        part = back(forward(x[i : i + step], size) * seen, size)[: min(size, len(out) - i)]
        out[i : i + len(part)] += part
    return out


def cwt(x: np.ndarray, wavelet: str = "ricker", n_scales: int = 32, lo: float = 1.0, hi: float | None = None, spacing: str = "geom", top_k: int | None = None) -> Transform:
    """Real wavelet coefficients by scale, their energies, and modes that add up to the series.

    A wavelet reaches ``min(10 s, n)`` steps to each side; the full convolution is cut to the series'
    centre.  ``top_k`` keeps the scales of most energy, in order of scale.
    """
    if wavelet not in WAVELETS:
        raise ValueError(f"no wavelet named {wavelet!r}")
    n, scales, out = len(x), scale_grid(len(x), n_scales, lo, hi, spacing), []
    for s in scales:
        w = int(min(10 * s, n))
        taps = WAVELETS[wavelet](np.arange(-w, w + 1) / s) / np.sqrt(s)
        out.append(np.real(convolved(x, taps)[w : w + n]))
    coeffs = np.array(out)
    energies = (coeffs**2).sum(1)
    if top_k is not None and top_k < len(scales):
        keep = np.sort(np.argsort(-energies, kind="stable")[:top_k])
        scales, coeffs, energies = scales[keep], coeffs[keep], energies[keep]
    whole = coeffs.sum(0)
    return Transform(scales, coeffs, energies, coeffs * (x / np.where(np.abs(whole) > 1e-12, whole, 1.0)))


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The solution of a_i x_(i-1) + b_i x_i + c_i x_(i+1) = d_i, diagonally dominant, by cyclic reduction: each
    step couples every row to rows twice as far away, until the coupling vanishes."""
    a, b, c, d = (np.asarray(v, float).copy() for v in (a, b, c, d))
    n, s = len(b), 1

    def shifted(v: np.ndarray, by: int, fill: float) -> np.ndarray:
        out = np.full(n, fill)
        out[max(0, by) : n + min(0, by)] = v[max(0, -by) : n - max(0, by)]
        return out

    while s < n and max(np.abs(a / b).max(), np.abs(c / b).max()) > 1e-18:
        up, down = -a / shifted(b, s, 1.0), -c / shifted(b, -s, 1.0)
        b, d, a, c = (
            b + up * shifted(c, s, 0.0) + down * shifted(a, -s, 0.0), d + up * shifted(d, s, 0.0) + down * shifted(d, -s, 0.0),
            up * shifted(a, s, 0.0), down * shifted(c, -s, 0.0),
        )
        s *= 2
    return d / b


def _spline(at: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """A natural cubic spline through (at, y), evaluated at 0, ..., n - 1."""
    if len(at) < 3:
        return np.interp(np.arange(n), at, y)
    h = np.diff(at)
    inner = tridiagonal(np.append(0.0, h[1:-1]), 2 * (h[:-1] + h[1:]), np.append(h[1:-1], 0.0), 6 * np.diff(np.diff(y) / h))
    m = np.concatenate([[0.0], inner, [0.0]])
    t = np.arange(n)
    i = np.clip(np.searchsorted(at, t, side="right") - 1, 0, len(h) - 1)
    u, v = t - at[i], at[i + 1] - t
    return (m[i] * v**3 + m[i + 1] * u**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * v + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * u


def _envelope(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A spline through extrema, which are mirrored once at each end."""
    n = len(x)
    left, right = -at[: 2][::-1], 2 * (n - 1) - at[-2:][::-1]
    where = np.concatenate([left, at, right])
    where, first = np.unique(where, return_index=True)
    return _spline(where.astype(float), np.concatenate([x[at[:2]][::-1], x[at], x[at[-2:]][::-1]])[first], n)


def emd(x: np.ndarray, max_modes: int = 8, sifts: int = 50, tolerance: float = 0.2) -> np.ndarray:
    """Empirical modes from fast to slow, the residual last; they add up to the series."""
    rest, out = np.asarray(x, float).copy(), []
    while len(out) < max_modes:
        mode = rest.copy()
        for _ in range(sifts):
            d = np.sign(np.diff(mode))
            high = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            low = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(high) < 2 or len(low) < 2:
                break
            centre = (_envelope(mode, high) + _envelope(mode, low)) / 2
            change = (centre**2).sum() / max((mode**2).sum(), 1e-12)
            mode = mode - centre
            if change < tolerance**2:
                break
        else:
            high = low = np.zeros(2)
        if len(high) < 2 or len(low) < 2:
            break
        out.append(mode)
        rest = rest - mode
    return np.array([*out, rest])


def modes(x: np.ndarray, method: str, **options) -> np.ndarray:
    """``cwt``, ``emd``, or any function (series, **options) -> modes given as the method itself."""
    if callable(method):
        return np.asarray(method(x, **options))
    if method == "emd":
        return emd(x, **options)
    if method == "cwt":
        return cwt(x, **options).modes
    raise ValueError(f"no decomposition named {method!r}")


def cwt_column(x: Column, **options) -> Column:
    """array<struct<scale, frequency, energy>> of each series."""

    @F.pandas_udf("array<struct<scale:double,frequency:double,energy:double>>")
    def made(rows: pd.Series) -> pd.Series:
        done = [cwt(np.asarray(r, float), **options) for r in rows]
        return pd.Series([[{"scale": s, "frequency": f, "energy": e} for s, f, e in zip(t.scales, t.frequencies, t.energies)] for t in done])

    return made(x)


def modes_column(x: Column, method: str, max_modes: int | None = None, include_original: bool = False, length: int | None = None, flatten: bool = False, **options) -> Column:
    """Modes as channels, time-major (array<array<double>>), or channel after channel with ``flatten``
    (array<double>, for kernels of flat series).  ``length`` keeps the last values, or repeats the series'
    first value in front."""

    def one(row: np.ndarray) -> np.ndarray:
        x = np.asarray(row, float)
        channels = modes(x, method, **options)[:max_modes]
        channels = np.vstack([x[None], channels]) if include_original else channels
        if length is not None:
            channels = channels[:, -length:] if channels.shape[1] >= length else np.pad(channels, ((0, 0), (length - channels.shape[1], 0)), "edge")
        return channels

    if flatten:
        @F.pandas_udf("array<double>")
        def flat(rows: pd.Series) -> pd.Series:
            return pd.Series([one(r).ravel() for r in rows])

        return flat(x)

    @F.pandas_udf("array<array<double>>")
    def deep(rows: pd.Series) -> pd.Series:
        return pd.Series([one(r).T.tolist() for r in rows])

    return deep(x)
