"""Triangles and preference cycles of edge flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i < j < k with margins m_ij, m_jk, m_ik and supports s_ij, s_jk, s_ik: a three-way equi-join of the edges."""
    pick = lambda x, y: edges.select(*keys, F.col("i").alias(x), F.col("j").alias(y), F.col("margin").alias(f"m_{x}{y}"), F.col("support").alias(f"s_{x}{y}"))
    return pick("i", "j").join(pick("j", "k"), [*keys, "j"]).join(pick("i", "k"), [*keys, "i", "k"])


def with_cycle(tri: DataFrame, tau: float = 0.0) -> DataFrame:
    """Adds cyclic (i > j > k > i or its reverse, each beyond tau) and intensity |product of margins|."""
    ahead = (F.col("m_ij") > tau) & (F.col("m_jk") > tau) & (F.col("m_ik") < -tau)
    back = (F.col("m_ij") < -tau) & (F.col("m_jk") < -tau) & (F.col("m_ik") > tau)
    return tri.withColumn("forward", ahead).withColumn("cyclic", ahead | back).withColumn("intensity", F.abs(F.col("m_ij") * F.col("m_jk") * F.col("m_ik")))


def margin_cycle_stats(edges: DataFrame, keys: list[str], min_support: float, tau: float = 0.0) -> DataFrame:
    """Rule of margins: a triple is eligible if all three edges have the support and a margin beyond tau."""
    kept = edges.where((F.col("support") >= min_support) & (F.abs("margin") > tau))
    tri = with_cycle(triangles(kept, keys), tau)
    stats = tri.groupBy(*keys).agg(F.count("*").alias("eligible"), F.count_if("cyclic").alias("cyclic"), F.sum(F.when(F.col("cyclic"), F.col("intensity")).otherwise(0.0)).alias("_sum"))
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    return sizes.join(stats, keys, "left").select(
        *keys, "n_edges", F.coalesce("eligible", F.lit(0)).alias("eligible"), F.coalesce("cyclic", F.lit(0)).alias("cyclic"), F.try_divide("cyclic", "eligible").alias("cycle_rate"), F.try_divide("_sum", "eligible").alias("weighted_cycle_intensity")
    )


def small_cycle_stats(edges: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The statistics of ``margin_cycle_stats`` without thresholds, for many scopes of few alternatives each and of ``least`` edges or more: a scope's edges are a row and its triangles are
    found there, so that edges aren't joined with each other. Where rows are dealt by a part of the keys already, nothing is shuffled."""
    near = edges.where(F.abs("margin") > 0).groupBy(*keys, "i").agg(F.collect_list(F.struct("j", F.col("margin").alias("m"))).alias("_to"))
    rows = near.groupBy(*keys).agg(F.sum(F.size("_to")).alias("n_edges"), F.map_from_entries(F.collect_list(F.struct("i", "_to"))).alias("_near")).where(F.col("n_edges") >= least)
    margin = lambda to, k: F.get(F.filter(to, lambda z: z["j"] == k), 0)["m"]
    third = lambda to, x: F.transform(F.element_at("_near", x["j"]), lambda y: F.struct(x["m"].alias("m_ij"), y["m"].alias("m_jk"), margin(to, y["j"]).alias("m_ik")))
    paths = F.flatten(F.transform(F.map_values("_near"), lambda to: F.flatten(F.filter(F.transform(to, lambda x: third(to, x)), lambda a: a.isNotNull()))))
    rows = rows.withColumn("_t", F.filter(paths, lambda t: t["m_ik"].isNotNull())).drop("_near")
    turns = F.filter("_t", lambda t: (F.signum(t["m_ij"]) == F.signum(t["m_jk"])) & (F.signum(t["m_ij"]) == -F.signum(t["m_ik"])))
    total = F.aggregate(turns, F.lit(0.0), lambda s, t: s + F.abs(t["m_ij"] * t["m_jk"] * t["m_ik"]))
    rows = rows.select(*keys, "n_edges", F.size("_t").cast("long").alias("eligible"), F.size(turns).cast("long").alias("cyclic"), total.alias("_sum"))
    return rows.select(*keys, "n_edges", "eligible", "cyclic", F.try_divide("cyclic", "eligible").alias("cycle_rate"), F.try_divide("_sum", "eligible").alias("weighted_cycle_intensity"))


def support_cycle_grid(edges: DataFrame, keys: list[str], n_mins, taus) -> DataFrame:
    """Rule of support on a grid: eligible by support alone, tau only in the test; triangles are joined once."""
    tri = triangles(edges, keys)
    grid = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n_min"), F.lit(float(t)).alias("tau")) for n in n_mins for t in taus]))
    rows = tri.withColumn("_g", grid).where("least(s_ij, s_jk, s_ik) >= _g.n_min")
    low = F.least(F.col("m_ij"), F.col("m_jk"), -F.col("m_ik"))
    high = F.greatest(F.col("m_ij"), F.col("m_jk"), -F.col("m_ik"))
    cyclic = (low > F.col("_g.tau")) | (high < -F.col("_g.tau"))
    size = F.abs(F.col("m_ij") * F.col("m_jk") * F.col("m_ik"))
    return rows.groupBy(*keys, F.col("_g.n_min").alias("n_min"), F.col("_g.tau").alias("tau")).agg(
        F.count("*").alias("eligible_triples"), F.count_if(cyclic).alias("cyclic_triples"), F.sum(F.when(cyclic, size).otherwise(0.0)).alias("intensity_sum"), F.coalesce(F.avg(F.when(cyclic, size)), F.lit(0.0)).alias("intensity_mean")
    ).withColumn("cycle_rate", F.col("cyclic_triples") / F.col("eligible_triples"))


def strongest_cycles(edges: DataFrame, keys: list[str], n_min: float, k: int, tau: float = 0.0) -> DataFrame:
    """The k strongest cycles of a scope, oriented so that model_1 beats model_2 beats model_3 beats model_1."""
    tri = with_cycle(triangles(edges.where(F.col("support") >= n_min), keys), tau).where("cyclic")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("intensity", 9)), "i", "j", "k")
    turn = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    return tri.withColumn("cycle_rank", F.row_number().over(order)).where(F.col("cycle_rank") <= k).select(
        *keys, "cycle_rank", turn("i", "k").alias("model_1"), F.col("j").alias("model_2"), turn("k", "i").alias("model_3"), "intensity", F.least(F.abs("m_ij"), F.abs("m_jk"), F.abs("m_ik")).alias("min_abs_margin")
    )


def triplet_residual(edges: DataFrame, keys: list[str], min_support: float = 0.0) -> DataFrame:
    """Scalar projection residual of every triangle in closed form: the circulation squared over the summed resistances."""
    tri = triangles(edges.where(F.col("support") >= min_support), keys)
    around = F.col("m_ij") + F.col("m_jk") - F.col("m_ik")
    residual = around * around / (1 / F.col("s_ij") + 1 / F.col("s_jk") + 1 / F.col("s_ik"))
    total = F.col("s_ij") * F.col("m_ij") ** 2 + F.col("s_jk") * F.col("m_jk") ** 2 + F.col("s_ik") * F.col("m_ik") ** 2
    return with_cycle(tri).withColumn("residual_energy", residual).withColumn("total_energy", total).withColumn("rho", F.when(F.col("total_energy") > 0, F.col("residual_energy") / F.col("total_energy")))
