"""Binomial draws in numpy arrays, each from its own counter: the same key and number of a draw give the same value wherever it is made."""

from __future__ import annotations

import math

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Up to this mean (of the rarer outcome) draws go by inversion, beyond it by rejection.
INVERSION = 10.0
_EXACT = np.array([math.lgamma(k + 1) - ((k + 0.5) * math.log(k + 1) - (k + 1) + 0.5 * math.log(2 * math.pi)) for k in range(10)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each entry (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, turn: int) -> np.ndarray:
    """In (0, 1), from the key and the number of the draw."""
    with np.errstate(over="ignore"):
        return ((mixed(keys + _GOLDEN * np.uint64(turn + 1)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _stirling(k: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks of log k!."""
    k1 = k + 1.0
    series = (1 / 12 - (1 / 360 - 1 / 1260 / (k1 * k1)) / (k1 * k1)) / k1
    return np.where(k < 10, _EXACT[np.clip(k, 0, 9).astype(np.int64)], series)


def _by_inversion(keys: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    u = uniforms(keys, 0)
    out = np.zeros(len(n), np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        mass = np.exp(n * np.log1p(-p))
        odds = p / (1 - p)
    total, live, k = mass.copy(), np.flatnonzero(u > mass), 0
    while len(live):
        mass[live] *= odds[live] * (n[live] - k) / (k + 1)
        k += 1
        total[live] += mass[live]
        out[live] = k
        live = live[(u[live] > total[live]) & (k < n[live])]
    return out


def _by_rejection(keys: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Transformed rejection with a squeeze (Hoermann 1993); rejected entries draw again with their next numbers."""
    spread = np.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * spread
    a = -0.0873 + 0.0248 * b + 0.01 * p
    c, vr, alpha, odds, mode = n * p + 0.5, 0.92 - 4.2 / b, (2.83 + 5.1 / b) * spread, p / (1 - p), np.floor((n + 1) * p)
    out, live, turn = np.zeros(len(n), np.int64), np.arange(len(n)), 0
    while len(live):
        u, v = uniforms(keys[live], turn) - 0.5, uniforms(keys[live], turn + 1)
        turn += 2
        us = 0.5 - np.abs(u)
        al, bl, nl, ml, rl = a[live], b[live], n[live], mode[live], odds[live]
        k = np.floor((2 * al / us + bl) * u + c[live])
        inside = (k >= 0) & (k <= nl)
        kk = np.clip(k, 0, nl)
        with np.errstate(divide="ignore"):
            height = np.log(v * alpha[live] / (al / (us * us) + bl))
        limit = (ml + 0.5) * np.log((ml + 1) / (rl * (nl - ml + 1))) + (nl + 1) * np.log((nl - ml + 1) / (nl - kk + 1)) + (kk + 0.5) * np.log(rl * (nl - kk + 1) / (kk + 1)) + _stirling(ml) + _stirling(nl - ml) - _stirling(kk) - _stirling(nl - kk)
        taken = ((us >= 0.07) & (v <= vr[live]) & inside) | (inside & (height <= limit))
        out[live[taken]] = k[taken].astype(np.int64)
        live = live[~taken]
    return out


def binomials(keys: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A binomial draw for each entry; all three of one shape, keys 64 bits each."""
    shape = keys.shape
    keys, n, p = keys.ravel().astype(np.uint64), n.ravel().astype(np.float64), np.clip(p.ravel().astype(np.float64), 0.0, 1.0)
    rare = np.minimum(p, 1 - p)
    small = n * rare <= INVERSION
    out = np.zeros(len(n), np.int64)
    out[small] = _by_inversion(keys[small], n[small], rare[small])
    out[~small] = _by_rejection(keys[~small], n[~small], rare[~small])
    return np.where(p > 0.5, n.astype(np.int64) - out, out).reshape(shape)
