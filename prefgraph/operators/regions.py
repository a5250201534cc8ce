"""Region analysis: triplets of alternatives, trained on one side of a split and tested on the other.

Everything depends on observations through sums per pair only, so these are made once for all splits, scopes and sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.operators.cycles import triplet_residual
from prefgraph.operators.edges import scoped_edge_flow
from prefgraph.operators.models import LOSSES, bt_triplet, edge_losses, mean_losses, pairwise_p, sigmoid
from prefgraph.operators.ordering import kept, quantiles
from prefgraph.operators.summaries import corr

#: Splits in a mask of a prompt's test splits.
MASK = 32

KEYS = ["split", "scope", "aspect"]
REGION = [*KEYS, "i", "j", "k"]


def split_flows(obs: DataFrame, splits: DataFrame, n_splits: int) -> tuple[DataFrame, DataFrame]:
    """Edge flows of the training and of the test prompts by (split, scope, aspect); ``splits`` are numbered from 0.

    A prompt's test splits are the bits of a mask, and observations that are alike are counted once for each bit in one pass, so that none is dealt to splits as a row. Every prompt is on one side of
    every split: the training sums are what the test sums leave of those over everything. With weights that are binary fractions, as labels give, the differences are exact.
    """
    sums = ["support", "weighted_margin", "i_wins", "j_wins", "n_obs"]
    edge = ["scope", "aspect", "i", "j"]
    words = range(-(-n_splits // MASK))
    bit = lambda c: F.expr(f"case when split div {MASK} = {c} then shiftleft(1L, cast(split % {MASK} as int)) end")
    masks = splits.where("is_test").groupBy("prompt_id").agg(*[F.bit_or(bit(c)).alias(f"_m{c}") for c in words])
    dealt = obs.join(masks, "prompt_id", "left")
    counts = [F.count_if(F.expr(f"(_m{s // MASK} & {1 << s % MASK}L) <> 0")).alias(f"_n{s}") for s in range(n_splits)]
    cells = kept(dealt.groupBy("annotation_group", "aspect", "i", "j", "sign", "weight").agg(F.count("*").alias("n"), *counts), "split-cells")
    alike = ["annotation_group", "aspect", "i", "j", "sign", "weight"]
    tested = cells.select(*alike, F.posexplode(F.array(*[f"_n{s}" for s in range(n_splits)])).alias("split", "n")).where("n > 0")
    test = kept(scoped_edge_flow(tested, ["split", "aspect"], "annotation_group", copies="n"), "test-flow")
    numbers = obs.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("split"))
    whole = scoped_edge_flow(cells.select(*alike, "n"), ["aspect"], "annotation_group", copies="n").drop("margin").join(F.broadcast(numbers))
    rest = whole.join(test.select("split", *edge, *[F.col(c).alias(f"_{c}") for c in sums]), ["split", *edge], "left")
    train = rest.select("split", *edge, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]).where("n_obs > 0")
    # a few rows per scope, read by every model
    return kept(train.withColumn("margin", F.col("weighted_margin") / F.col("support")), "train-flow"), test


def trained_triplets(train: DataFrame, min_support: float) -> DataFrame:
    """Eligible triplets with their residual and cycle, and win weights of both sides of each edge."""
    tri = triplet_residual(train, KEYS, min_support)
    for x, y in (("i", "j"), ("j", "k"), ("i", "k")):
        s, m = F.col(f"s_{x}{y}"), F.col(f"m_{x}{y}")
        tri = tri.withColumn(f"w_{x}{y}", s * (1 + m) / 2).withColumn(f"l_{x}{y}", s * (1 - m) / 2)
    return tri.where("rho is not null")


def _edges(tri: DataFrame, probabilities: dict[str, object]) -> DataFrame:
    """A row per triplet and edge with P(first wins)."""
    rows = [F.struct(F.col(x).alias("a"), F.col(y).alias("b"), p.alias("p")) for (x, y), p in probabilities.items()]
    return tri.select(*REGION, F.explode(F.array(*rows)).alias("_e")).select(*REGION, "_e.*")


def _tested(predicted: DataFrame, test: DataFrame, prefix: str) -> DataFrame:
    held = test.select(*KEYS, F.col("i").alias("a"), F.col("j").alias("b"), "i_wins", "j_wins")
    return mean_losses(edge_losses(predicted.join(held, [*KEYS, "a", "b"]), "p", "i_wins", "j_wins"), REGION, prefix)


def region_table(train: DataFrame, test: DataFrame, min_support: float = 5, min_test_weight: float = 5, min_test_edges: int = 2, smoothing: float = 1.0) -> DataFrame:
    """A row per region: training residual and cycle, held-out losses of the scalar (bt) and the pairwise (pair) model, uplift."""
    tri = trained_triplets(train, min_support)
    pair = {(x, y): pairwise_p(F.col(f"s_{x}{y}"), F.col(f"s_{x}{y}") * F.col(f"m_{x}{y}"), smoothing) for x, y in (("i", "j"), ("j", "k"), ("i", "k"))}
    fitted = bt_triplet(tri)
    bt = {(x, y): sigmoid(F.col(f"score_{x}") - F.col(f"score_{y}")) for x, y in (("i", "j"), ("j", "k"), ("i", "k"))}
    pair_losses = _tested(_edges(tri, pair), test, "pair")
    bt_losses = _tested(_edges(fitted, bt), test, "bt").drop("bt_weight", "bt_edges")
    out = fitted.select(*REGION, "rho", "cyclic", "intensity", F.least("s_ij", "s_jk", "s_ik").alias("min_support"), (F.col("s_ij") + F.col("s_jk") + F.col("s_ik")).alias("total_weight"), (F.abs("m_ij") + F.abs("m_jk") + F.abs("m_ik")).alias("_m"), "gradient_norm")
    out = out.withColumn("mean_abs_margin", F.col("_m") / 3).drop("_m").join(pair_losses, REGION).join(bt_losses, REGION)
    out = out.where((F.col("pair_weight") >= min_test_weight) & (F.col("pair_edges") >= min_test_edges))
    return out.withColumns({f"uplift_{m}": F.col(f"bt_{m}") - F.col(f"pair_{m}") for m in LOSSES})


def routing_table(regions: DataFrame, keys: list[str], fractions=(0.0, 0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Weighted losses when the share ``fraction`` of regions with the highest residual goes to the pairwise model."""
    at = quantiles(regions, keys, "rho", {f"_{k}": 1 - f for k, f in enumerate(fractions)})
    cuts = at.select(*keys, F.array(*[F.struct(F.lit(f).alias("fraction"), F.col(f"_{k}").alias("cut")) for k, f in enumerate(fractions)]).alias("_f"))
    stacked = ", ".join(f"'{m}', bt_{m}, pair_{m}" for m in LOSSES)
    rows = regions.select(*keys, "rho", F.col("pair_weight").alias("w"), F.expr(f"stack({len(LOSSES)}, {stacked}) as (metric, scalar, pairwise)"))
    rows = rows.join(cuts, keys).withColumn("_f", F.explode("_f"))
    route = (F.col("_f.fraction") >= 1) | ((F.col("_f.fraction") > 0) & (F.col("rho") >= F.col("_f.cut")))
    mean = lambda x: F.try_divide(F.sum(F.col("w") * x), F.sum("w"))
    out = rows.groupBy(*keys, "metric", F.col("_f.fraction").alias("fraction")).agg(mean(F.col("scalar")).alias("scalar_value"), mean(F.col("pairwise")).alias("all_pairwise_value"), mean(F.when(route, F.col("pairwise")).otherwise(F.col("scalar"))).alias("routed_value"))
    return out.withColumn("improvement_vs_scalar", F.col("scalar_value") - F.col("routed_value"))


def outcome_cube(regions: DataFrame, outcomes: list[str]) -> DataFrame:
    """Means by scope, by aspect, by both and of all, in one pass."""
    long = regions.select("scope", "aspect", "rho", F.expr(f"stack({len(outcomes)}, " + ", ".join(f"'{o}', {o}" for o in outcomes) + ") as (outcome, value)"))
    return long.cube("scope", "aspect", "outcome").agg(F.grouping_id("scope", "aspect", "outcome").alias("_g"), F.count("value").alias("n"), F.avg("value").alias("mean"), corr("rho", "value").alias("corr_rho")).where("_g % 2 = 0").select(
        F.when(F.col("_g").isin(4, 6), "every").otherwise(F.col("scope")).alias("scope"), F.when(F.col("_g").isin(2, 6), "every").otherwise(F.col("aspect")).alias("aspect"), "outcome", "n", "mean", "corr_rho"
    )


def region_means(regions: DataFrame, columns: list[str]) -> DataFrame:
    """Regions averaged over splits."""
    return regions.groupBy("scope", "aspect", "i", "j", "k").agg(F.count("*").alias("n_rows"), F.count_distinct("split").alias("n_splits"), *[F.avg(c).alias(c) for c in columns])
