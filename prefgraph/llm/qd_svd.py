"""Singular values and right singular vectors of a small square matrix: Householder bidiagonalisation, dqds, twisted factorisations.

The matrix is that of one covariance (its order is the number of dimensions); nothing here grows with rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = np.finfo(np.float64).tiny


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, alpha) with (1 - tau v v^T) x = alpha e1."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0, float(x[0])
    y = x / scale
    alpha = -np.copysign(np.linalg.norm(y), y[0])
    v = y.copy()
    v[0] -= alpha
    return v, 2.0 / (v @ v), float(alpha * scale)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal and superdiagonal of B = U^T R V, and the reflectors whose product is V."""
    a, n, right = r.astype(np.float64).copy(), len(r), []
    for k in range(n):
        v, tau, a_k = _reflector(a[k:, k])
        a[k:, k + 1 :] -= np.outer(tau * v, v @ a[k:, k + 1 :])
        a[k:, k] = 0
        a[k, k] = a_k
        if k + 2 < n:
            v, tau, a_k = _reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k + 1 :] @ v, tau * v)
            a[k, k + 1 :] = 0
            a[k, k + 1] = a_k
            right.append((k + 1, v, tau))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: np.ndarray, e: np.ndarray, shift: float):
    """One differential step of the qd algorithm with a shift: (q, e, least d), or None where the shift was too large."""
    n = len(q)
    q_new, e_new, d = np.empty(n), np.empty(n - 1), q[0] - shift
    least = d
    for k in range(n - 1):
        if d < 0:
            return None
        q_new[k] = d + e[k]
        ratio = q[k + 1] / q_new[k] if q_new[k] > 0 else 0.0
        e_new[k] = e[k] * ratio
        d = d * ratio - shift if q_new[k] > 0 else q[k + 1] - shift
        least = min(least, d)
    if d < 0 or not np.isfinite(d):
        return None
    q_new[n - 1] = d
    return q_new, e_new, least


def _corner(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller eigenvalue of the last two rows, which the least of all can't exceed."""
    x = q[-2] + (e[-2] if len(e) > 1 else 0.0)
    y, off2 = q[-1] + e[-1], q[-2] * e[-1]
    high = (x + y) / 2 + np.hypot((x - y) / 2, np.sqrt(off2))
    return max((x * y - off2) / high, 0.0) if high > 0 else 0.0


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the upper bidiagonal matrix with diagonal a and superdiagonal b, falling. Only sums of
    positive numbers and shifts below the least value are taken, so that small values are as accurate as large ones."""
    out, todo = [], [(a * a, b * b, 0.0)]
    while todo:
        q, e, shifted = todo.pop()
        least = None
        while len(q) > 1:
            cut = np.flatnonzero(e <= EPS**2 * (shifted + np.minimum(q[1:], q[:-1])))
            if len(cut):
                c = int(cut[-1]) + 1
                todo.append((q[:c], e[: c - 1], shifted))
                q, e, least = q[c:], e[c:], None
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = 0.0 if least is None else min(least, _corner(q, e)) * (1 - 1e-3 if len(q) > 2 else 1 - 1e-9)
            step = _sweep(q, e, shift) if shift > EPS * shifted else None
            if step is None and shift > 0:
                shift /= 4
                step = _sweep(q, e, shift) if shift > EPS * shifted else None
            if step is None:
                shift, step = 0.0, _sweep(q, e, 0.0)
            q, e, least = step
            shifted += shift
        if len(q):
            out.append(q[0] + shifted)
    return np.sort(np.array(out))[::-1]


def _twisted(diag: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """(z, residual factor) of an eigenvector of L D L^T nearest to ``value``: stationary from the top, progressive from the bottom, joined
    where the twist is least."""
    n = len(diag)
    down, up, s, p = np.empty(n - 1), np.empty(n - 1), np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        d = s[k] + diag[k] or -TINY
        down[k] = diag[k] * low[k] / d
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[n - 1] = diag[n - 1] - value
    for k in range(n - 2, -1, -1):
        d = diag[k] * low[k] * low[k] + p[k + 1] or -TINY
        t = diag[k] / d
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    gamma = s + p + value
    gamma = np.where(np.isfinite(gamma), np.abs(gamma), np.inf)
    r = int(np.argmin(gamma))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z, float((s + p + value)[r])


def _block_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of B^T B for the values given, columns; B's superdiagonal holds no zeros. Vectors of values closer than a
    thousandth are made orthogonal to each other."""
    n = len(a)
    if n == 1:
        return np.ones((1, len(values)))
    safe = np.where(a == 0, np.sqrt(TINY), a)
    diag, low = safe * safe, b / safe[:-1]
    out = np.zeros((n, len(values)))
    for c, value in enumerate(values):
        near = [x for x in range(c) if values[x] - value <= 1e-3 * max(values[x], TINY)]
        with np.errstate(all="ignore"):
            z, twist = _twisted(diag, low, value)
            size = z @ z
            better = value + twist / size
            if not near and np.isfinite(better) and better > 0 and abs(better - value) <= 1e-6 * value:
                z = _twisted(diag, low, better)[0]
        z = z / np.abs(z).max() if np.all(np.isfinite(z)) else np.random.default_rng(c).normal(size=n)
        z /= np.linalg.norm(z)
        for _ in range(2):
            for x in near:
                z = z - out[:, x] * (out[:, x] @ z)
        if near and np.linalg.norm(z) < 0.1:  # the twist gave a neighbour's vector again: inverse steps beside the neighbours
            z = np.random.default_rng(c).normal(size=n)
            full = np.diag(a * a) + np.diag(np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
            for _ in range(4):
                z = np.linalg.solve(full - (value * (1 + 2 * EPS) + TINY) * np.eye(n), z)
                for _ in range(2):
                    for x in near:
                        z = z - out[:, x] * (out[:, x] @ z)
                z /= np.linalg.norm(z)
        out[:, c] = z / np.linalg.norm(z)
    return out


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of r that aren't zero at its precision, falling, and their right singular vectors as
    columns; of each vector the entry of largest size is positive."""
    n = len(r)
    a, b, reflectors = bidiagonalise(r)
    edge = EPS * max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= edge) + 1).tolist(), n]
    parts = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        values = dqds(a[lo:hi], b[lo : hi - 1])
        parts += [(float(v), lo, hi, k) for k, v in enumerate(values)]
    parts.sort(key=lambda x: -x[0])
    least = (n * EPS) ** 2 * parts[0][0] if parts else 0.0
    kept = [x for x in parts[:most] if x[0] > least]
    vectors = np.zeros((n, len(kept)))
    for lo, hi in sorted({(x[1], x[2]) for x in kept}):
        here = [c for c, x in enumerate(kept) if x[1] == lo]
        vectors[lo:hi, here] = _block_vectors(a[lo:hi], b[lo : hi - 1], np.array([kept[c][0] for c in here]))
    for at, v, tau in reversed(reflectors):
        vectors[at:] -= np.outer(tau * v, v @ vectors[at:])
    vectors /= np.linalg.norm(vectors, axis=0)
    if vectors.size:
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.array([x[0] for x in kept]), vectors
