"""Window functions for framed transforms: designed once on the driver, a few thousand numbers at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cosine_sum(n: int, *terms: float) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / n
    return sum((-1) ** k * a * np.cos(k * t) for k, a in enumerate(terms))


def _axis(n: int) -> np.ndarray:
    """Periodic sample positions from -1/2 to 1/2."""
    return np.arange(n + 1)[:n] / n - 0.5


def _unit(w: np.ndarray) -> np.ndarray:
    return w / np.sqrt(np.mean(w**2))


def _root(n: int) -> np.ndarray:
    return np.sqrt(np.maximum(1 - 4 * _axis(n) ** 2, 1e-24))


def knab(n: int, alpha: float) -> np.ndarray:
    r = _root(n)
    return _unit(np.sinh(np.pi * alpha * r) / (np.sinh(np.pi * alpha) * r))


def cosh(n: int, alpha: float) -> np.ndarray:
    r = _root(n)
    return _unit(np.cosh(np.pi * alpha * r) / (np.cosh(np.pi * alpha) * r))


def bessel_i1(x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of order one by its power series."""
    term = x / 2
    total = term.copy()
    for k in range(1, 120):
        term = term * (x / 2) ** 2 / (k * (k + 1))
        total = total + term
    return total


def modified_bessel(n: int, alpha: float) -> np.ndarray:
    r = _root(n)
    w = bessel_i1(np.pi * alpha * r) / (bessel_i1(np.array([np.pi * alpha])) * r)
    w[0] = 0.0
    return _unit(w)


def confined_gaussian(n: int, sigma: float) -> np.ndarray:
    """Approximate confined Gaussian of temporal width sigma, peak one."""
    g = lambda k: np.exp(-(((k - (n - 1) / 2) / (2 * n * sigma)) ** 2))
    k = np.arange(n)
    w = g(k) - g(-0.5) * (g(k + n) + g(k - n)) / (g(-0.5 + n) + g(-0.5 - n))
    return w / w.max()


def chebyshev(n: int, attenuation: float) -> np.ndarray:
    """Dolph-Chebyshev window with side lobes ``attenuation`` decibels down, peak one: the transform of a Chebyshev polynomial."""
    m = n  # the periodic window of n samples is a symmetric one of n + 1 samples without its last
    edge = np.cosh(np.arccosh(10 ** (abs(attenuation) / 20)) / m)
    x = edge * np.cos(np.pi * np.arange(m + 1) / (m + 1))
    with np.errstate(invalid="ignore"):
        poly = np.where(np.abs(x) <= 1, np.cos(m * np.arccos(np.clip(x, -1, 1))), np.cosh(m * np.arccosh(np.maximum(np.abs(x), 1))) * np.where(x < 0, (-1.0) ** m, 1.0))
    half = np.exp(1j * np.pi * np.arange(m + 1) / (m + 1)) if (m + 1) % 2 == 0 else 1.0
    w = np.fft.fft(poly * half).real
    first = (m + 1) // 2 + 1 if (m + 1) % 2 == 0 else m // 2 + 1
    w = np.concatenate([w[first - 1 : 0 : -1], w[1:first]]) if (m + 1) % 2 == 0 else np.concatenate([w[first - 1 : 0 : -1], w[:first]])
    return (w / w.max())[:n]


def taylor(n: int, bars: int = 4, level: float = 30.0) -> np.ndarray:
    """Taylor window: ``bars`` nearly equal side lobes ``level`` decibels down, mean one in its middle."""
    a = np.arccosh(10 ** (level / 20)) / np.pi
    widen = bars**2 / (a**2 + (bars - 0.5) ** 2)
    k = np.arange(1, bars)
    terms = np.empty(bars - 1)
    for i, m in enumerate(k):
        top = np.prod(1 - m**2 / widen / (a**2 + (k - 0.5) ** 2))
        terms[i] = -((-1) ** m) * top / (2 * np.prod([1 - m**2 / j**2 for j in k if j != m]))
    shape = lambda t: 1 + 2 * np.cos(2 * np.pi * np.multiply.outer(t, k)) @ terms
    return shape((np.arange(n) - n / 2) / (n + 1)) / shape(np.array([0.0]))


def slepian(n: int, half_bandwidth: float) -> np.ndarray:
    """First discrete prolate spheroidal sequence of time-half-bandwidth product ``half_bandwidth``, peak one.

    The commuting tridiagonal matrix has it as its top eigenvector; inverse iteration from the top of the spectrum finds it in O(n).
    """
    m = n + 1
    k = np.arange(m)
    diagonal = ((m - 1 - 2 * k) / 2) ** 2 * np.cos(2 * np.pi * half_bandwidth / m)
    off = k[1:] * (m - k[1:]) / 2
    radius = np.zeros(m)
    radius[:-1] += off
    radius[1:] += off
    low, high = diagonal.min() - radius.max(), (diagonal + radius).max()
    for _ in range(200):  # bisection by the sign count of the pivots: the largest eigenvalue
        mid = (low + high) / 2
        pivot, above = 1.0, 0
        for i in range(m):
            pivot = diagonal[i] - mid - (off[i - 1] ** 2 / pivot if i else 0.0)
            pivot = pivot or 1e-300
            above += pivot > 0
        low, high = (mid, high) if above else (low, mid)
        if high - low <= 1e-14 * max(1.0, abs(high)):
            break
    v = np.ones(m)
    for _ in range(4):
        c, d = np.zeros(m), np.zeros(m)
        for i in range(m):
            den = diagonal[i] - high - (off[i - 1] * c[i - 1] if i else 0.0)
            den = den or 1e-300
            c[i] = off[i] / den if i < m - 1 else 0.0
            d[i] = (v[i] - (off[i - 1] * d[i - 1] if i else 0.0)) / den
        for i in range(m - 2, -1, -1):
            d[i] -= c[i] * d[i + 1]
        v = d / np.abs(d).max()
    v = np.abs(v + v[::-1])
    return (v / v.max())[:n]


MAKERS = {
    "rect": lambda n: np.ones(n),
    "hamming": lambda n: _cosine_sum(n, 0.54, 0.46),
    "hann": lambda n: _cosine_sum(n, 0.5, 0.5),
    "blackman": lambda n: _cosine_sum(n, 0.42, 0.5, 0.08),
    "blackmanharris": lambda n: _cosine_sum(n, 0.35875, 0.48829, 0.14128, 0.01168),
    "kaiser": lambda n, beta: np.kaiser(n + 1, beta)[:n],
    "knab": knab,
    "cosh": cosh,
    "modified_bessel": modified_bessel,
    "acg": confined_gaussian,
    "chebwin": chebyshev,
    "taylor": taylor,
    "dpss": slepian,
}


def window(name: str | tuple, n: int, zeros: int = 0, normalise: bool = True, center: bool = False, center_zeros: bool = False) -> np.ndarray:
    """A periodic window of ``n`` samples with ``zeros`` of them zero; unit mean square; ``center`` moves frequency zero to the middle."""
    key, args = (name, ()) if isinstance(name, str) else (name[0], name[1:])
    w = MAKERS[key](n - zeros, *args)
    lead = zeros // 2 if center_zeros else 0
    w = np.concatenate([np.zeros(lead), w, np.zeros(zeros - lead)])
    if normalise:
        w = _unit(w)
    return w * (-1.0) ** np.arange(n) if center else w


def noise_bandwidth(name: str | tuple, n: int) -> float:
    """Equivalent noise bandwidth in bins."""
    w = window(name, n, normalise=False)
    return n * np.sum(w**2) / np.sum(w) ** 2


def parameter_for_bandwidth(name: str, target: float, n: int = 4096, low: float = 0.01, high: float = 60.0, atol: float = 1e-6) -> float:
    """Bisect the shape parameter at which the window has the noise bandwidth ``target`` (in bins)."""
    rising = noise_bandwidth((name, high), n) > noise_bandwidth((name, low), n)
    for _ in range(200):
        mid = (low + high) / 2
        have = noise_bandwidth((name, mid), n)
        if abs(have - target) <= atol:
            break
        low, high = (mid, high) if (have < target) == rising else (low, mid)
    return mid


def bandwidths(sizes: DataFrame, name: str | tuple, size: str = "nfft") -> DataFrame:
    """Rows with ``noise_bandwidth`` (in bins) of the window at their size; each distinct size is worked out once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"__size": f[size], "noise_bandwidth": [float(noise_bandwidth(name, int(n))) for n in f[size]]})

    found = sizes.select(F.col(size).cast("long")).distinct().mapInPandas(run, "__size long, noise_bandwidth double")
    return sizes.join(found, F.col(size) == F.col("__size")).drop("__size")
