"""Scalar projection of edge flows: weighted least squares of margins by differences of scores.

The normal equations are solved per scope by a fixed number of damped Jacobi steps, written as array functions over one row
per scope, so any number of scopes (groups, splits, resamples) runs in one job. The gradient's norm is given as a quality
column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, DAMPING = 60, 0.8


def graph_projection(edges: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """keys, total_energy, residual_energy, gradient_energy, rho, gradient_norm, nodes, scores. edges: i, j, margin, support > 0."""
    both = edges.select(*keys, F.col("i").alias("n"), F.col("j").alias("o"), F.col("margin").alias("m"), F.col("support").cast("double").alias("w")).unionByName(edges.select(*keys, F.col("j").alias("n"), F.col("i").alias("o"), (-F.col("margin")).alias("m"), F.col("support").cast("double").alias("w")))
    nodes = both.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("o", "w"))).alias("nb"), F.sum("w").alias("deg"), F.sum(F.col("w") * F.col("m")).alias("b"))
    # a scope is one row: its nodes are the alternatives, few by nature
    scope = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "deg", "b", "nb"))).alias("g"))
    scope = scope.withColumn("names", F.col("g.n")).withColumn("g", F.transform("g", lambda x: F.struct(x["deg"].alias("deg"), x["b"].alias("b"), F.transform(x["nb"], lambda e: F.struct((F.array_position(F.col("g.n"), e["o"]) - 1).cast("int").alias("o"), e["w"].alias("w"))).alias("nb"))))
    zero = F.transform("g", lambda x: F.lit(0.0))
    pull = lambda r, x: F.aggregate(x["nb"], F.lit(0.0), lambda s, e: s + e["w"] * F.get(r, e["o"]))
    step = lambda r, _: F.transform(F.col("g"), lambda x, k: F.get(r, k) + DAMPING * ((x["b"] + pull(r, x)) / x["deg"] - F.get(r, k)))
    solved = scope.withColumn("r", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step))
    norm = F.aggregate(F.transform("g", lambda x, k: F.pow(x["deg"] * F.get(F.col("r"), k) - x["b"] - pull(F.col("r"), x), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    mean = F.aggregate("r", F.lit(0.0), lambda s, v: s + v) / F.size("r")
    fitted = solved.select(*keys, "names", F.transform("r", lambda v: v - mean).alias("scores"), F.sqrt(norm).alias("gradient_norm"))
    at = fitted.select(*keys, F.map_from_arrays("names", "scores").alias("_s"))
    fit = edges.join(at, keys).withColumn("_f", F.element_at("_s", F.col("i")) - F.element_at("_s", F.col("j")))
    w, m = F.col("support").cast("double"), F.col("margin")
    energy = fit.groupBy(*keys).agg(F.sum(w * m * m).alias("total_energy"), F.sum(w * (m - F.col("_f")) ** 2).alias("residual_energy"), F.sum(w * F.col("_f") ** 2).alias("gradient_energy"), F.max(F.abs("_f")).alias("max_abs_fitted"))
    return energy.join(fitted, keys).withColumn("rho", F.when(F.col("total_energy") > 0, F.col("residual_energy") / F.col("total_energy")))


def projection_scores(edges: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """keys, node, score (mean 0)."""
    return graph_projection(edges, keys, steps).select(*keys, F.explode(F.arrays_zip(F.col("names").alias("node"), F.col("scores").alias("score"))).alias("_z")).select(*keys, F.col("_z.node").alias("node"), F.col("_z.score").alias("score"))
