"""Tournaments within strata of users: by stated values (clusters) and by where they come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefgraph.operators import clusters, edges, null_draws, ordering, summaries
from prefgraph.operators.models import bt_graph
from prefgraph.plans import attributes, comparisons, inference
from prefgraph.sources.fixtures import table

CLUSTERS, DELTA, MIN_SUPPORT, DRAWS = (3, 5), 5, 2, 200


def user_values(spark, sf_dir):
    """A user's stated values: the means of their conversations' attributes."""
    return attributes.long(spark, sf_dir).where("user_id is not null").groupBy("user_id").pivot("attribute", attributes.NAMES).agg(F.round(F.avg("value"), 9))


def strata_stats(flow, keys, users):
    """Per stratum: users, edges, cycles and residual of the flow, against draws from the stratum's own Bradley-Terry scores, with q over strata."""
    flow = ordering.kept(flow, "strata-flow")
    fine = flow.where(F.col("support") >= MIN_SUPPORT)
    observed = null_draws.observed_stats(flow, keys, MIN_SUPPORT, 0.0)
    scores = bt_graph(fine, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", "theta"))).alias("_t")).select(*keys, F.col("_t.node").alias("nodes"), F.col("_t.theta").alias("scores"))
    cells = fine.select(*keys, "i", "j", F.lit(1.0).alias("weight"), F.col("support").alias("n"))
    null = null_draws.null_stats(cells, scores, keys, DRAWS, inference.SEED, null_draws.logistic)
    rows = null.select(*keys, "rep", F.col("rho").alias("value")).join(observed.select(*keys, F.col("rho").alias("observed")), keys).where("value is not null and observed is not null")
    against = summaries.calibrated_summary(rows, keys, "value", "observed").select(*keys, "null_mean", "z", "p_ge")
    sizes = fine.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    out = users.join(observed, keys).join(sizes, keys, "left").join(against, keys, "left")
    return summaries.bh_q(ordering.kept(out, "strata"), [], "p_ge")


def cluster_tournaments(spark, sf_dir):
    """For 3 and 5 clusters of users by stated values: each cluster's cycles and residual, the user-weighted mean residual within clusters and the pooled one."""
    pairs = ordering.kept(comparisons.pairs(spark, sf_dir).where(F.col("score_delta") == DELTA), "cluster-pairs")
    vectors = clusters.standardised(user_values(spark, sf_dir), "user_id", attributes.NAMES)
    pooled = null_draws.observed_stats(edges.user_edge_flow(pairs, ["score_delta"]), ["score_delta"], MIN_SUPPORT, 0.0).select(F.col("rho").alias("pooled_rho"))
    parts = [clusters.k_means(vectors, "user_id", k)[0].withColumn("k", F.lit(k)) for k in CLUSTERS]
    named = parts[0]
    for part in parts[1:]:
        named = named.unionByName(part)
    named = ordering.kept(named, "clusters")
    flow = edges.user_edge_flow(pairs.join(named, "user_id"), ["k", "cluster"])
    users = named.groupBy("k", "cluster").agg(F.count("*").alias("n_users"))
    stats = ordering.kept(strata_stats(flow, ["k", "cluster"], users), "cluster-stats")
    mean = stats.where("rho is not null").groupBy("k").agg((F.sum(F.col("n_users") * F.col("rho")) / F.sum("n_users")).alias("within_rho"))
    return stats.join(mean, "k", "left").join(F.broadcast(pooled))  # one row


def nation_pairs(spark, sf_dir):
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("stratum"))
    return comparisons.pairs(spark, sf_dir).where(F.col("score_delta") == DELTA).join(nation, "user_id")


def stratum_flow(spark, sf_dir):
    """User-weighted edge flow within nations."""
    return edges.user_edge_flow(nation_pairs(spark, sf_dir), ["stratum"]).withColumn("margin", F.round("margin", 6) + 0.0)


def stratum_tournaments(spark, sf_dir):
    pairs = ordering.kept(nation_pairs(spark, sf_dir), "nation-pairs")
    return strata_stats(edges.user_edge_flow(pairs, ["stratum"]), ["stratum"], pairs.groupBy("stratum").agg(F.count_distinct("user_id").alias("n_users")))


QUERIES = {"cluster_tournaments": cluster_tournaments, "stratum_flow": stratum_flow, "stratum_tournaments": stratum_tournaments}

ORACLE_SQL = {
    "stratum_flow": f"""with {comparisons.PAIR_SQL}, sp as (select c_nationkey::bigint as stratum, pairs.* from pairs join customer on c_custkey = user_id where score_delta = {DELTA} and pair_sign <> 0),
um as (select stratum, user_id, i, j, avg(pair_sign) as m, count(*) as n from sp group by 1, 2, 3, 4) select stratum, i, j, round(avg(m), 6) + 0.0 as margin, count(*) as support, sum(n)::bigint as total_observations from um group by 1, 2, 3""",
}
