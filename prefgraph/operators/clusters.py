"""Users grouped by their stated values: k-means|| seeds, Lloyd steps from sums, and tournaments within the groups.

Vectors are standardised, distances are column expressions over literal centres (a few times the dimensions), and each step is one aggregation with partial sums; nothing
but centres and candidates (about twice k a round) reaches the driver. Choices are hashes of (seed, round, user), so that reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefgraph.functions.hashing import uniform
from prefgraph.operators.ordering import kept

ROUNDS, STEPS = 5, 50


def standardised(users: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, v): z-scores of the columns as an array, 0 where a user has none or the column doesn't vary."""
    moments = users.agg(*[f(c).alias(f"_{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{k}"), F.nullif(F.col(f"_s{k}"), F.lit(0.0))), F.lit(0.0)) for k, c in enumerate(columns)]
    return users.join(F.broadcast(moments)).select(key, F.array(*z).alias("v"))  # one row of moments


def squared_distance(v: Column, centre) -> Column:
    return sum(((F.get(v, F.lit(k)) - float(c)) ** 2 for k, c in enumerate(centre)), F.lit(0.0))


def nearest(v: Column, centres: np.ndarray) -> Column:
    """struct(d, cluster): the least squared distance and the first centre that has it."""
    return F.array_min(F.array(*[F.struct(F.round(squared_distance(v, c), 12).alias("d"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)]))


def seeds(vectors: DataFrame, key: str, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres: candidates drawn round by round in proportion to their squared distance from those there, weighted by the users nearest to each, and thinned to k
    by the same rule on these weights."""
    first = vectors.select("v", uniform(seed, F.col(key)).alias("u")).orderBy("u", "v").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    candidates = [first[0]["v"]]
    for turn in range(rounds):
        far = vectors.withColumn("_d", nearest(F.col("v"), np.array(candidates))["d"])
        total = far.agg(F.sum("_d")).first()[0]
        if not total:
            break
        drawn = far.where(uniform(seed + 1, F.lit(turn), F.col(key)) < F.lit(2.0 * k) * F.col("_d") / F.lit(total))
        candidates += [r["v"] for r in drawn.select("v").distinct().orderBy("v").collect()]  # about 2 k
    points = np.array(candidates)
    counts = {r["cluster"]: r["count"] for r in vectors.select(nearest(F.col("v"), points)["cluster"].alias("cluster")).groupBy("cluster").count().collect()}
    weight = np.array([counts.get(c, 0) for c in range(len(points))], float)
    rng, chosen = np.random.default_rng(seed), [int(weight.argmax())]
    while len(chosen) < min(k, len(points)):
        gap = ((points[:, None, :] - points[chosen][None]) ** 2).sum(axis=2).min(axis=1) * weight
        if gap.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=gap / gap.sum())))
    return points[chosen]


def k_means(vectors: DataFrame, key: str, k: int, seed: int = 7, steps: int = STEPS) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster) and the centres: Lloyd steps until no centre moves. Clusters are numbered by their centres' order; fewer than k where there are fewer
    distinct vectors; an empty table has none."""
    vectors = kept(vectors.select(key, "v"), "cluster-vectors")
    centres = seeds(vectors, key, k, seed)
    for _ in range(steps if len(centres) else 0):
        d = centres.shape[1]
        near = vectors.select("v", nearest(F.col("v"), centres)["cluster"].alias("cluster"))
        sums = near.groupBy("cluster").agg(*[F.avg(F.get("v", F.lit(m))).alias(f"_{m}") for m in range(d)]).collect()
        moved = centres.copy()
        for r in sums:
            moved[r["cluster"]] = [round(r[f"_{m}"], 10) for m in range(d)]
        if np.array_equal(moved, centres):
            break
        centres = moved
    if not len(centres):
        return vectors.select(key, F.lit(0).alias("cluster")), centres
    centres = centres[np.lexsort(centres.T[::-1])]
    return vectors.select(key, nearest(F.col("v"), centres)["cluster"].alias("cluster")), centres
