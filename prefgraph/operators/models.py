"""Scalar and pairwise models of edge flows, and their evaluation on held-out edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWTON_STEPS, MM_STEPS, L2 = 12, 200, 0.01


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bt_triplet(tri: DataFrame, l2: float = L2) -> DataFrame:
    """Adds score_i, score_j, score_k and gradient_norm of a Bradley-Terry fit with a penalty on the two free scores.

    ``tri`` has win weights w_ij, l_ij (i over j, j over i), w_jk, l_jk, w_ik, l_ik. Damped Newton steps on (a, b) = scores of
    i and j, with k at 0, as an array fold: no Python, a row per triplet. Scores are centred.
    """
    c = F.col

    def slopes(a, b):
        gij = sigmoid(a - b) * (c("w_ij") + c("l_ij")) - c("w_ij")
        gik = sigmoid(a) * (c("w_ik") + c("l_ik")) - c("w_ik")
        gjk = sigmoid(b) * (c("w_jk") + c("l_jk")) - c("w_jk")
        return gij + gik + l2 * a, gjk - gij + l2 * b

    def step(s, _):
        a, b = s["a"], s["b"]
        ga, gb = slopes(a, b)
        curve = lambda z, w: sigmoid(z) * (1 - sigmoid(z)) * w
        hij, hik, hjk = curve(a - b, c("w_ij") + c("l_ij")), curve(a, c("w_ik") + c("l_ik")), curve(b, c("w_jk") + c("l_jk"))
        haa, hbb, hab = hij + hik + l2, hij + hjk + l2, -hij
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        short = F.when(F.greatest(F.abs(da), F.abs(db)) > 2, 2 / F.greatest(F.abs(da), F.abs(db))).otherwise(F.lit(1.0))
        return F.struct((a - short * da).alias("a"), (b - short * db).alias("b"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    fit = tri.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), zero, step))
    ga, gb = slopes(c("_s.a"), c("_s.b"))
    mean = (c("_s.a") + c("_s.b")) / 3
    return fit.withColumn("gradient_norm", F.sqrt(ga * ga + gb * gb)).withColumn("score_i", c("_s.a") - mean).withColumn("score_j", c("_s.b") - mean).withColumn("score_k", -mean).drop("_s")


def bt_graph(edges: DataFrame, keys: list[str], steps: int = MM_STEPS) -> DataFrame:
    """keys, node, theta: Bradley-Terry on a whole graph by minorisation steps on pseudo-wins clip((m + 1) / 2) * support."""
    p = F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), (F.col("margin") + 1) / 2))
    n = F.col("support").cast("double")
    both = edges.select(*keys, F.col("i").alias("n"), F.col("j").alias("o"), (p * n).alias("win"), n.alias("w")).unionByName(edges.select(*keys, F.col("j").alias("n"), F.col("i").alias("o"), ((1 - p) * n).alias("win"), n.alias("w")))
    nodes = both.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("o", "w"))).alias("nb"), F.sum("win").alias("win"))
    scope = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "win", "nb"))).alias("g")).withColumn("names", F.col("g.n"))
    scope = scope.withColumn("g", F.transform("g", lambda x: F.struct(x["win"].alias("win"), F.transform(x["nb"], lambda e: F.struct((F.array_position(F.col("names"), e["o"]) - 1).cast("int").alias("o"), e["w"].alias("w"))).alias("nb"))))
    start = F.transform("g", lambda x: F.lit(1.0))
    step = lambda r, _: F.transform(F.col("g"), lambda x, k: x["win"] / F.aggregate(x["nb"], F.lit(0.0), lambda s, e: s + e["w"] / (F.get(r, k) + F.get(r, e["o"]))))
    fit = scope.withColumn("r", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    logs = F.transform("r", lambda v: F.log(v))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, v: s + v) / F.size("r")
    out = fit.select(*keys, F.explode(F.arrays_zip(F.col("names").alias("node"), F.transform(logs, lambda v: v - mean).alias("theta"))).alias("_z"))
    return out.select(*keys, F.col("_z.node").alias("node"), F.col("_z.theta").alias("theta"))


def pairwise_p(support: Column, weighted_margin: Column, smoothing: float = 1.0) -> Column:
    """Smoothed probability that i wins."""
    return (0.5 * (support + weighted_margin) + smoothing) / (support + 2 * smoothing)


def edge_losses(rows: DataFrame, p: str, wi: str, wj: str) -> DataFrame:
    """Adds weight and weighted losses of a predicted P(i wins) on an edge with win weights of both sides."""
    q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col(p)))
    a, b = F.col(wi), F.col(wj)
    return rows.withColumns(
        {
            "weight": a + b,
            "log_loss": -a * F.log(q) - b * F.log(1 - q),
            "brier": a * (1 - q) ** 2 + b * q**2,
            "error": F.when(q > 0.5, b).when(q < 0.5, a).otherwise((a + b) / 2),
            "pair_calibration": F.abs(q * (a + b) - a),
            "majority_error": F.when((a == b) | (q == 0.5), (a + b) / 2).when((a > b) == (q > 0.5), F.lit(0.0)).otherwise(a + b),
        }
    )


LOSSES = ("log_loss", "brier", "error", "pair_calibration", "majority_error")


def mean_losses(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("weight").alias(f"{prefix}_weight"), F.count("*").alias(f"{prefix}_edges"), *[F.try_divide(F.sum(m), F.sum("weight")).alias(f"{prefix}_{m}") for m in LOSSES])


def prediction_metrics(rows: DataFrame, keys: list[str], p: str = "p_a") -> DataFrame:
    """Metrics of externally made P(A) on single observations (sign, weight, i, j, a_is_i): orientation checks included."""
    q = F.when(F.col("a_is_i"), F.col(p)).otherwise(1 - F.col(p))
    pairs = rows.withColumn("_q", q).groupBy(*keys, "i", "j").agg(F.sum(F.when(F.col("sign") > 0, F.col("weight")).otherwise(0.0)).alias("_wi"), F.sum(F.when(F.col("sign") < 0, F.col("weight")).otherwise(0.0)).alias("_wj"), (F.sum(F.col("weight") * F.col("_q")) / F.sum("weight")).alias("_p"))
    out = mean_losses(edge_losses(pairs, "_p", "_wi", "_wj"), keys, "straight")
    flipped = mean_losses(edge_losses(pairs.withColumn("_p", 1 - F.col("_p")), "_p", "_wi", "_wj"), keys, "flipped").drop("flipped_weight", "flipped_edges")
    return out.join(flipped, keys)


#: Metrics of single scored rows and of their pairs, as expressions of the sums that ``row_metrics`` makes.
ROW_METRICS = {
    "weight": "weight",
    "log_loss": "log_loss",
    "brier": "brier",
    "accuracy": "1 - error_rate",
    "error_rate": "error_rate",
    "calibration": "abs(mean_target_a - mean_p_a)",
    "pair_calibration": "pair_calibration",
    "majority_error": "majority_error",
    "flipped_log_loss": "flipped_log_loss",
    "flipped_brier": "flipped_brier",
    "flipped_error_rate": "flipped_error_rate",
    "flipped_pair_calibration": "flipped_pair_calibration",
    "flipped_majority_error": "flipped_majority_error",
    "flip_gain": "error_rate - flipped_error_rate",
    "flip_majority_gain": "majority_error - flipped_majority_error",
    "majority_less_row_error": "majority_error - error_rate",
    "mean_target_a": "mean_target_a",
    "mean_p_a": "mean_p_a",
    "pair_mean_observed": "pair_mean_observed",
    "pair_mean_predicted": "pair_mean_predicted",
    "observed_majority_i": "observed_majority_i",
    "predicted_majority_i": "predicted_majority_i",
    "target_mismatch": "target_mismatch",
}


def row_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_obs, edges and ``ROW_METRICS`` of scored rows (row_sign of A, sign of i, weight, i, j, a_is_i, p_a): weighted means over rows and over
    pairs, the same of 1 - p_a, and how often a row's winner isn't its edge's.

    A prediction of 0.5 says A; a pair whose observed or predicted rate is one half has majority error one half.
    """
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p_a")))
    rows = rows.select(*keys, "i", "j", "a_is_i", "weight", p.alias("p"), (F.col("row_sign") > 0).cast("int").alias("a"), (F.col("sign") > 0).cast("int").alias("t"))
    mean = lambda x: F.sum(F.col("weight") * x) / F.sum("weight")
    q, a = F.col("p"), F.col("a")
    loss = lambda x: -F.when(a == 1, F.log(x)).otherwise(F.log(1 - x))
    wrong = lambda x: ((x >= 0.5) != (a == 1)).cast("int")
    of_rows = rows.groupBy(*keys).agg(
        F.sum("weight").alias("weight"), F.count("*").alias("n_obs"), mean(loss(q)).alias("log_loss"), mean(loss(1 - q)).alias("flipped_log_loss"), mean((q - a) ** 2).alias("brier"), mean((1 - q - a) ** 2).alias("flipped_brier"),
        mean(wrong(q)).alias("error_rate"), mean(wrong(1 - q)).alias("flipped_error_rate"), mean(a).alias("mean_target_a"), mean(q).alias("mean_p_a"),
        mean((F.when(F.col("a_is_i"), a).otherwise(1 - a) != F.col("t")).cast("int")).alias("target_mismatch"),
    )
    pairs = rows.groupBy(*keys, "i", "j").agg(mean(F.col("t")).alias("o"), mean(F.when(F.col("a_is_i"), q).otherwise(1 - q)).alias("q"), F.sum("weight").alias("weight"))
    o, q = F.col("o"), F.col("q")
    even = (F.abs(2 * o - 1) <= 1e-9) | (F.abs(2 * q - 1) <= 1e-9)
    missed = lambda other: F.when(even, 0.5).when((o > 0.5) != other, 1.0).otherwise(0.0)
    of_pairs = pairs.groupBy(*keys).agg(
        F.count("*").alias("edges"), mean(F.abs(o - q)).alias("pair_calibration"), mean(F.abs(o - (1 - q))).alias("flipped_pair_calibration"), mean(missed(q > 0.5)).alias("majority_error"), mean(missed(q <= 0.5)).alias("flipped_majority_error"),
        mean(o).alias("pair_mean_observed"), mean(q).alias("pair_mean_predicted"), mean((o > 0.5).cast("int")).alias("observed_majority_i"), mean((q > 0.5).cast("int")).alias("predicted_majority_i"),
    )
    return of_rows.join(of_pairs, keys).select(*keys, "n_obs", "edges", *[F.expr(e).alias(n) for n, e in ROW_METRICS.items()])
