"""Generalised Stirling numbers of many customers, by a table of two axes.

c customers of one dish sit at t tables in S(c, t) weighted ways, and

    S(c, t) = c! / (t! d^t) * [x^c] (1 - (1 - x)^d)^t

for the discount d. The coefficient is an integral around the branch point
x = 1, also for c and t between the integers: by quadrature along a parabola
where tables are few for the customers, by the saddle point where they are many.
What remains of log S beside the Lah numbers (d = -1) is a smooth function of
log c and log(t / (c - t + 1)) and is interpolated, so no row of c entries is
ever made. Against the recursion the logarithm is off by at most 0.004, at up to
20,000 customers and discounts from 0.05 to 0.95.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

STEP_C, STEP_T = 0.25, 0.125  # of the table's axes
FIRST = np.log(48.0)  # logarithm of the fewest customers covered


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    low = x < 8
    z = np.where(low, x + 8, x)
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / z**2) / z**2) / z
    if low.any():
        small = x[low] if x.ndim else x
        out = np.asarray(out)
        out[low] -= np.log(np.prod([small + k for k in range(8)], axis=0))
    return out


def _saddle(d: float, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the coefficient by the saddle point, 1 - x there)."""
    lo, hi = np.full(c.shape, -60.0), np.full(c.shape, 60.0)
    for _ in range(56):
        mid = (lo + hi) / 2
        log_w = _log_w(mid)
        up = t * d * np.exp((d - 1) * log_w) / (1 + np.exp(-mid)) < (c + 1) * -np.expm1(d * log_w)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    x, log_w = 1 / (1 + np.exp(-lo)), _log_w(lo)
    w, u = np.exp(log_w), -np.expm1(d * log_w)
    # derivatives of u over u, then those of log u
    one = d * np.exp((d - 1) * log_w) / u
    two = one * (1 - d) / w
    three = two * (2 - d) / w
    four = three * (3 - d) / w
    logs = two - one**2, three - 3 * one * two + 2 * one**3, four - 4 * one * three - 3 * two**2 + 12 * one**2 * two - 6 * one**4
    return t * np.log(u) - (c + 1) * np.log(x) + _around(*(t * g + h for g, h in zip(logs, _powers(c + 1, x), strict=True))), w


def _powers(n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second to fourth derivative of -n log x."""
    return n / x**2, -2 * n / x**3, 6 * n / x**4


def _around(two: np.ndarray, three: np.ndarray, four: np.ndarray) -> np.ndarray:
    """Log of the integral around a saddle point with these derivatives, to second order."""
    more = four / (8 * two**2) - 5 * three**2 / (24 * two**3)  # small where the saddle point is used
    return np.log1p(np.maximum(more, -0.5)) - 0.5 * np.log(2 * np.pi * two)


def _log_w(logit: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0, logit)


def _lah_saddle(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The same approximation for the coefficient of (x / (1 - x))^t."""
    n, x = c + 1 - t, (c + 1 - t) / (c + 1)
    w = t / (c + 1)
    return -n * np.log(x) - t * np.log(w) + _around(*(g + h * sign for g, h, sign in zip(_powers(n, x), _powers(t, w), (1, -1, 1), strict=True)))


def _parabola(d: float, c: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log of the coefficient by quadrature along 1 - x = w (1 + i tau)^2."""
    w = np.maximum(w, 1 / c)
    ratio = d * w ** (d - 1) / (1 - w**d)
    slope = (c + 1) / (1 - w) - t * ratio
    bend = (c + 1) / (1 - w) ** 2 + t * (d * (1 - d) * w ** (d - 2) / (1 - w**d) - ratio**2)
    width = 1 / np.sqrt(np.maximum(4 * w**2 * bend + 2 * w * slope, 1))
    # x^-(c+1) alone gives 0, so the power may be taken less 1 where it is near 1
    near = t * w**d < 0.5
    top = np.where(near, 0, t * np.log1p(-(w**d))) - (c + 1) * np.log1p(-w)
    total = np.zeros(len(c))
    for y in np.arange(0, 8, 0.1):
        bent = 1 + 1j * width * np.sinh(y)
        power, rest = t * np.log1p(-np.exp(d * (np.log(w) + 2 * np.log(bent)))), -(c + 1) * np.log1p(-w * bent**2) - top
        f = np.exp(power + rest) - np.where(near, np.exp(np.where(near, rest, 0)), 0)
        low = near & (np.abs(power) < 1)
        f[low] = np.expm1(power[low]) * np.exp(rest[low])
        f *= bent
        total += (f.real * width * np.cosh(y)) * (0.05 if y == 0 else 0.1)
    return top + np.log(2 * w / np.pi * total)


def beside_lah(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S(c, t) less the log of the Lah number."""
    log_p, w = _saddle(d, c, t)
    out = log_p - _lah_saddle(c, t)
    few = w < 0.7  # towards 1 the parabola would leave the valley
    out[few] = _parabola(d, c[few], t[few], w[few]) - (lgamma(c) - lgamma(t) - lgamma(c - t + 1))[few]
    return out - t * np.log(d)


@lru_cache(maxsize=8)
def _table(d: float, bits: int) -> np.ndarray:
    """``beside_lah`` per table, by customers (rows, below 2^bits) and tables (columns)."""
    rows = FIRST + STEP_C * np.arange(int((bits * np.log(2) - FIRST) / STEP_C) + 3)
    side = int(rows[-1] / STEP_T) + 3
    y, v = np.meshgrid(rows, STEP_T * np.arange(-side, side + 1), indexing="ij")
    out = np.zeros(y.shape)
    use = np.abs(v) < y + 4 * STEP_T + 4 * STEP_C
    c = np.exp(y[use])
    t = (c + 1) / (1 + np.exp(-v[use]))
    out[use] = beside_lah(d, c, t) / t
    return out


def _weights(x: np.ndarray) -> list[np.ndarray]:
    """Of the four neighbours, for a place x after the second."""
    return [-x * (x - 1) * (x - 2) / 6, (x + 1) * (x - 1) * (x - 2) / 2, -(x + 1) * x * (x - 2) / 2, (x + 1) * x * (x - 1) / 6]


def log_stirling(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S(c, t) - log c!, for c from 64 and t from 1 to c."""
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    table = _table(d, 8 * (int(np.log2(c.max(initial=64))) // 8 + 1))
    width, flat, out = table.shape[1], table.ravel(), 0.0
    y = (np.log(c) - FIRST) / STEP_C
    v = np.log(t / (c - t + 1)) / STEP_T + width // 2
    j, k = y.astype(np.int64), v.astype(np.int64)
    at = (j - 1) * width + k - 1
    by_t = _weights(v - k)
    for a, by_c in enumerate(_weights(y - j)):
        out = out + by_c * sum(f * flat[at + (a * width + b)] for b, f in enumerate(by_t))
    low = lgamma(t)
    return t * out + lgamma(c) - 2 * low - np.log(t) - lgamma(c - t + 1)


@lru_cache(maxsize=4)
def few_tables(d: float, customers: int, tables: int) -> np.ndarray:
    """log S(c, t) by the recursion, for c below ``customers`` and t from 1 to ``tables``."""
    s, t = np.full((customers, tables + 1), -np.inf), np.arange(1, tables + 1)
    s[1, 1] = 0
    for c in range(1, customers - 1):
        more = np.log(np.maximum(c - d * t, 1e-300)) + s[c, 1:]
        s[c + 1, 1:] = np.logaddexp(s[c, :-1], more)
        s[c + 1, c + 2:] = -np.inf
    return s[:, 1:].copy()
