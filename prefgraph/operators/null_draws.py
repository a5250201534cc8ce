"""Null draws of edge flows: wins of every pair drawn anew many times, and of each draw the projection residual and the cycles.

A scope is a row, and blocks of its draws are rows of a job: a task draws the wins of a block as one matrix. The supports don't change between draws, so
the matrix that turns margins into residuals is made once for a block and the list of triangles too. Draws depend on the scope, the pair, the weight and the
draw's number alone.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.functions.draws import binomials, mixed
from prefgraph.operators.scope_arrays import each, graphs, incidence, solver

BLOCK = 250


class Graph:
    """A scope's pairs: statistics of any number of margin vectors over them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, support: np.ndarray, n: int, min_support: float):
        self.support, self.fine = support, support >= min_support
        w = np.where(self.fine, support, 0.0)
        edges = incidence(a, b, n)
        self.w, self.fit = w, edges @ solver(edges, w)
        at = {(x, y): k for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
        near = [set() for _ in range(n)]
        for x, y in at:
            near[x].add(y)
        found = [(at[x, y], at[y, z], at[x, z]) for x in range(n) for y, z in combinations(sorted(near[x]), 2) if (y, z) in at]
        self.triangles = np.array(found, np.int64).reshape(-1, 3)

    def rho(self, margins: np.ndarray) -> np.ndarray:
        """Share of the energy that no scores explain; NaN without energy. A row a draw."""
        left = margins - margins @ self.fit.T
        total = (margins * margins) @ self.w
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(total > 0, (left * left) @ self.w / total, np.nan)

    def cycles(self, margins: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
        """(eligible, cyclic) triples of each draw: all three pairs supported and beyond tau."""
        x = np.where(self.fine & (np.abs(margins) > tau), np.sign(margins), 0).astype(np.int8)
        ij, jk, ik = (x[:, self.triangles[:, k]] for k in range(3))
        eligible = (ij != 0) & (jk != 0) & (ik != 0)
        return eligible.sum(axis=1), (eligible & (ij == jk) & (ij == -ik)).sum(axis=1)


FIELDS = "rep int, rho double, cycle_rate double, cyclic_triples long, eligible_triples long"


def _stats(graph: Graph, margins: np.ndarray, reps: np.ndarray, tau: float) -> dict:
    eligible, cyclic = graph.cycles(margins, tau)
    none = lambda values: [None if v != v else v for v in values.tolist()]
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(eligible > 0, cyclic / np.maximum(eligible, 1), np.nan)
    return {"_rows": True, "rep": reps.tolist(), "rho": none(graph.rho(margins)), "cycle_rate": none(rate), "cyclic_triples": cyclic.tolist(), "eligible_triples": eligible.tolist()}


def additive(scores: np.ndarray, a: np.ndarray, b: np.ndarray, bound: float = 0.999) -> np.ndarray:
    """P(a wins) where the expected margin is the difference of scores."""
    return (1 + np.clip(scores[a] - scores[b], -bound, bound)) / 2


def logistic(scores: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(a wins) of Bradley-Terry scores."""
    return 1 / (1 + np.exp(scores[b] - scores[a]))


def observed_stats(flow: DataFrame, keys: list[str], min_support: float, tau: float) -> DataFrame:
    """keys, rho, cycle_rate, cyclic_triples, eligible_triples of the flow itself."""

    def kernel(nodes, a, b, margin, support):
        found = _stats(Graph(a, b, support, len(nodes), min_support), margin[None, :], np.zeros(1, np.int64), tau)
        del found["rep"]
        return found

    return each(graphs(flow.where("support > 0"), keys, ["margin", "support"]), keys, FIELDS.removeprefix("rep int, "), kernel)


def null_stats(cells: DataFrame, scores: DataFrame, keys: list[str], reps: int, seed: int, chance: Callable = additive, min_support: float = 0.0, tau: float = 0.0, block: int = BLOCK) -> DataFrame:
    """keys, rep, rho, cycle_rate, cyclic_triples, eligible_triples of ``reps`` draws.

    ``cells``: keys, i, j, weight, n (observations of that weight, kept in every draw); ``scores``: keys, nodes (sorted names), scores. ``chance``
    makes of scores the probability that a pair's first wins.
    """
    rows = graphs(cells, keys, ["weight", "n"]).join(scores.select(*keys, F.col("nodes").alias("_named"), "scores"), keys)
    rows = rows.withColumn("scope_key", F.xxhash64(F.lit(seed), *keys)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // block))))
    # blocks are dealt out, since a scope's row is small and its draws are the work
    rows = rows.repartition(max(1, min(rows.sparkSession.sparkContext.defaultParallelism * 4, (reps - 1) // block + 1)), *keys, "block")

    def kernel(nodes, a, b, weight, n, _named, scores, scope_key, block_number):
        if nodes != _named:
            raise ValueError("scores belong to other alternatives than the cells")
        numbers = np.arange(block_number * block, min(reps, (block_number + 1) * block))
        with np.errstate(over="ignore"):
            cell_keys = mixed(np.uint64(scope_key & (2**64 - 1)) + mixed(a.astype(np.uint64) << np.uint64(40) ^ b.astype(np.uint64) << np.uint64(20)) + mixed(weight.view(np.uint64)))
            drawn = binomials(mixed(cell_keys[None, :] + mixed(numbers.astype(np.uint64))[:, None]), np.broadcast_to(n, (len(numbers), len(n))), np.broadcast_to(chance(scores, a, b), (len(numbers), len(n))))
        pairs, pair = np.unique(a.astype(np.int64) * len(nodes) + b, return_inverse=True)
        to_pair = np.zeros((len(n), len(pairs)))
        to_pair[np.arange(len(n)), pair] = 1
        support = (weight * n) @ to_pair
        margins = (weight * (2 * drawn - n)) @ to_pair / support
        return _stats(Graph(pairs // len(nodes), pairs % len(nodes), support, len(nodes), min_support), margins, numbers, tau)

    return each(rows.withColumnRenamed("block", "block_number"), keys, FIELDS, kernel)
