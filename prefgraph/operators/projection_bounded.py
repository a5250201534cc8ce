"""Scalar projection under a bound: weighted least squares of margins by differences of scores, none beyond the bound.

Where the unbounded optimum keeps the bound it is the answer. Elsewhere ADMM splits differences from scores (each step a product with a
matrix made once), finds which edges lie at the bound, and the problem with those as equations is solved exactly; of both the one with the smaller residual of
the optimality conditions is kept, and that residual is returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.operators.scope_arrays import each, graphs, incidence, solver

BOUND, STEPS, CLOSE = 0.999, 20_000, 1e-13


def _conditions(edges, w, m, r, force, bound) -> float:
    """How far (scores, forces at the bound) are from optimal: gradient, violation and forces that push inwards or act inside."""
    f = edges @ r
    gradient = np.abs(edges.T @ (w * (f - m) + force)).max(initial=0.0)
    beyond = np.maximum(np.abs(f) - bound, 0).max(initial=0.0)
    wrong = np.maximum(-force * np.sign(f), 0).max(initial=0.0)
    slack = np.minimum(np.abs(force), np.maximum(bound - np.abs(f), 0)).max(initial=0.0)
    return float(max(gradient, beyond, wrong, slack))


def _with_equations(edges, w, m, active, side, bound) -> tuple[np.ndarray, np.ndarray]:
    """Scores and forces if the active edges' differences are the bound."""
    fixed = edges[active]
    r = np.linalg.lstsq(fixed, side[active] * bound, rcond=None)[0]
    _, s, vt = np.linalg.svd(fixed)
    free = vt[(s > 1e-10 * s.max(initial=0)).sum() :].T
    root = np.sqrt(w)
    open_ = root[:, None] * (edges @ free)
    if np.abs(open_).max(initial=0.0) > 1e-9 * root.max(initial=0.0):  # else nothing but a common shift is free
        r = r + free @ np.linalg.lstsq(open_, root * (m - edges @ r), rcond=1e-10)[0]
    force = np.zeros(len(edges))
    force[active] = np.linalg.lstsq(fixed.T, -edges.T @ (w * (edges @ r - m)), rcond=None)[0]
    return r, force


def bounded_scores(a: np.ndarray, b: np.ndarray, m: np.ndarray, w: np.ndarray, n: int, bound: float) -> tuple[np.ndarray, float, int]:
    """(scores of mean 0, residual of the optimality conditions, steps): weights are scaled to at most 1 for the residual."""
    w = w / max(w.max(initial=0.0), 1e-300)
    edges = incidence(a, b, n)
    to_scores = solver(edges, w)
    r = to_scores @ m
    none = np.zeros(len(m))
    if np.abs(edges @ r).max(initial=0.0) <= bound:
        return r - r.mean(), _conditions(edges, w, m, r, none, bound), 0
    z, u, step = np.clip(edges @ r, -bound, bound), np.zeros(len(m)), 0
    for step in range(1, STEPS + 1):
        f = edges @ (to_scores @ (z - u))
        moved, z = z, np.clip((m + f + u) / 2, -bound, bound)
        u = u + f - z
        if max(np.abs(f - z).max(), np.abs(z - moved).max()) < CLOSE:
            break
    r = to_scores @ (z - u)
    force = w * (m + u - z)
    side = np.sign(z)
    best = r, _conditions(edges, w, m, r, force, bound)
    active = (np.abs(z) >= bound - 1e-9) & (force * side > 1e-9 * w)
    if active.any():
        exact, its_force = _with_equations(edges, w, m, active, side, bound)
        # dependent equations leave the forces open: then those found on the way count
        for f in (its_force, force):
            residual = _conditions(edges, w, m, exact, f, bound)
            if residual < best[1]:
                best = exact, residual
    return best[0] - best[0].mean(), best[1], step


def projection_bounded(flow: DataFrame, keys: list[str], bound: float = BOUND) -> DataFrame:
    """keys, nodes, scores, n_at_bound, max_abs_fitted, kkt_residual, steps, residual_energy, total_energy: a row for each scope."""

    def fit(nodes, a, b, margin, support):
        r, residual, steps = bounded_scores(a, b, margin, support, len(nodes), bound)
        f = np.clip(r[a] - r[b], -bound, bound)
        return {
            "node_names": nodes, "scores": r, "n_at_bound": int((np.abs(f) >= bound - 1e-5).sum()), "max_abs_fitted": float(np.abs(f).max(initial=0.0)), "kkt_residual": residual, "steps": steps,
            "residual_energy": float((support * (margin - f) ** 2).sum()), "total_energy": float((support * margin**2).sum()),
        }

    rows = graphs(flow.where("support > 0").withColumns({"i": F.col("i").cast("string"), "j": F.col("j").cast("string")}), keys, ["margin", "support"])
    return each(rows, keys, "node_names array<string>, scores array<double>, n_at_bound int, max_abs_fitted double, kkt_residual double, steps int, residual_energy double, total_energy double", fit).withColumnRenamed("node_names", "nodes")


def scores_of(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, score."""
    return fitted.select(*keys, F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("scores").alias("score"))).alias("_z")).select(*keys, F.col("_z.node").alias("node"), F.col("_z.score").alias("score"))
