"""Edge flows: support and signed margin per pair, by any scope. Sums are combined before the shuffle, so hot pairs cost little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sums(copies: str | None = None) -> list[Column]:
    w, s = F.col("weight") * F.col(copies) if copies else F.col("weight"), F.col("sign")
    n = F.sum(copies) if copies else F.count("*")
    return [F.sum(w).alias("support"), F.sum(w * s).alias("weighted_margin"), F.sum(F.when(s > 0, w).otherwise(0.0)).alias("i_wins"), F.sum(F.when(s < 0, w).otherwise(0.0)).alias("j_wins"), n.alias("n_obs")]


def edge_flow(obs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, support, weighted_margin, i_wins, j_wins, n_obs, margin."""
    return obs.groupBy(*keys, "i", "j").agg(*_sums()).withColumn("margin", F.col("weighted_margin") / F.col("support"))


def scoped_edge_flow(obs: DataFrame, keys: list[str], scope: str, name: str = "scope", copies: str | None = None) -> DataFrame:
    """Edge flow of everything ('all') and of each value of ``scope``, in one pass by grouping sets. ``copies``: how many observations a row stands for."""
    both = obs.groupingSets([[*keys, "i", "j"], [*keys, scope, "i", "j"]], *keys, scope, "i", "j").agg(*_sums(copies), F.grouping(scope).alias("_all"))
    return both.select(F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(scope)).alias(name), *keys, "i", "j", "support", "weighted_margin", "i_wins", "j_wins", "n_obs", (F.col("weighted_margin") / F.col("support")).alias("margin"))


def user_edge_flow(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted mean of signs within (user, pair), then the plain mean over users; support counts users.

    Without a weight the margin is a sum of whole numbers by the users' observations, divided as decimals: it is the double next to the exact
    mean whatever the order of the rows, so exact halves always round the same way.
    """
    rows = pairs.where("pair_sign <> 0")
    if weight is None:
        users = rows.groupBy(*keys, "user_id", "i", "j").agg(F.sum("pair_sign").alias("_s"), F.count("*").alias("_n"))
        by_n = users.groupBy(*keys, "i", "j", "_n").agg(F.sum("_s").alias("_s"), F.count("*").alias("_u"))
        users_, mean = F.sum("_u"), F.sum(F.col("_s").cast("decimal(15,0)") / F.col("_n").cast("decimal(23,0)"))
        return by_n.groupBy(*keys, "i", "j").agg((mean / users_.cast("decimal(20,0)")).cast("double").alias("margin"), users_.alias("support"), F.sum(F.col("_n") * F.col("_u")).alias("total_observations"))
    w = F.greatest(weight.cast("double"), F.lit(0.0)) / 100
    rows = rows.withColumn("_w", w).where("_w > 0")
    users = rows.groupBy(*keys, "user_id", "i", "j").agg((F.sum(F.col("_w") * F.col("pair_sign")) / F.sum("_w")).alias("_m"), F.count("*").alias("_n"))
    return users.groupBy(*keys, "i", "j").agg(F.avg("_m").alias("margin"), F.count("*").alias("support"), F.sum("_n").alias("total_observations"))


def conversation_edge_flow(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.greatest(weight.cast("double"), F.lit(0.0)) / 100
    rows = pairs.where("pair_sign <> 0").withColumn("_w", w).where("_w > 0")
    return rows.groupBy(*keys, "i", "j").agg((F.sum(F.col("_w") * F.col("pair_sign")) / F.sum("_w")).alias("margin"), F.count("*").alias("support"))


def weight_cells(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Observations per pair and weight."""
    return obs.groupBy(*keys, "i", "j", "weight").agg(F.count("*").alias("n"))


def scoped_weight_cells(obs: DataFrame, keys: list[str], scope: str, name: str = "scope") -> DataFrame:
    """Observations per pair and weight (n) and their signed weight, of everything ('all') and of each value of ``scope``."""
    both = obs.groupingSets([[*keys, "i", "j", "weight"], [*keys, scope, "i", "j", "weight"]], *keys, scope, "i", "j", "weight").agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("sign")).alias("signed"), F.grouping(scope).alias("_all"))
    return both.select(F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(scope)).alias(name), *keys, "i", "j", "weight", "n", "signed")


def skew(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of every edge: (a, b, margin) and (b, a, -margin)."""
    forward = edges.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"), "margin", "support")
    return forward.unionByName(edges.select(*keys, F.col("j").alias("a"), F.col("i").alias("b"), (-F.col("margin")).alias("margin"), "support"))
