"""Splits by counted ranges of hashes, and flows of both sides of every split, against plain dealing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prefgraph.operators import regions, resample
from prefgraph.operators.edges import scoped_edge_flow


@pytest.mark.parametrize("n, bits, share", [(1, 12, 0.2), (3, 12, 0.5), (240, 12, 0.2), (240, 1, 0.2), (5, 3, 1.0)])
def test_split_equals_ranks(spark, monkeypatch, n, bits, share):
    monkeypatch.setattr(resample, "CUT_BITS", bits)
    keys = [7 * k for k in range(n)]
    df = spark.createDataFrame([(k,) for k in keys for _ in range(2)], "prompt_id long")
    got = {(r["prompt_id"], r["split"]): r["is_test"] for r in resample.prompt_split(df, "prompt_id", 4, share, 9).collect()}
    for s in range(4):
        order = sorted(keys, key=lambda k: (hashlib.md5(f"9|{s}|{k}".encode()).hexdigest()[:8], k))
        most = max(1, round(n * share))
        assert all(got[k, s] == (at < most) for at, k in enumerate(order))
    assert len(got) == 4 * n


def test_equal_hashes_go_by_key(spark, monkeypatch):
    monkeypatch.setattr(resample, "hash_int", lambda seed, *keys: F.lit(5).cast("long"))
    got = {r["k"]: r["is_test"] for r in resample.prompt_split(spark.range(10).select(F.col("id").alias("k")), "k", 1, 0.3, 9).collect()}
    assert [k for k in range(10) if got[k]] == [0, 1, 2]


def test_no_order_over_all_prompts(spark):
    """Rows are compared with their split's cut: nothing is sorted or dealt by rank."""
    plan = resample.prompt_split(spark.range(50).select(F.col("id").alias("k")), "k", 3, 0.2, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "row_number" not in plan


def test_flows_equal_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(regions, "MASK", 3)
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice("xy"), rng.choice("pq"), *sorted(rng.sample("abcd", 2)), rng.choice((1, -1)), rng.choice((0.5, 1.0, 0.25))) for _ in range(600)]
    obs = spark.createDataFrame(rows, "prompt_id long, annotation_group string, aspect string, i string, j string, sign int, weight double")
    splits = resample.prompt_split(obs.where("prompt_id < 35"), "prompt_id", 7, 0.3, 3)
    train, test = regions.split_flows(obs, splits, 7)
    dealt = obs.join(splits.where("is_test"), "prompt_id")
    left = obs.join(spark.range(7).select(F.col("id").cast("int").alias("split"))).join(splits.where("is_test"), ["prompt_id", "split"], "left_anti")
    names = ["split", "scope", "aspect", "i", "j", "support", "weighted_margin", "i_wins", "j_wins", "n_obs", "margin"]
    for got, plain in ((test, dealt), (train, left)):
        want = scoped_edge_flow(plain, ["split", "aspect"], "annotation_group")
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))


def test_small_scopes_equal_joined_triangles(spark):
    """Cycles found within a scope's row are those of joined edges; scopes with few edges, none beyond zero and no triangle included."""
    from prefgraph.operators import cycles

    rng = random.Random(6)
    rows = [(s, x, y, rng.choice((-1.0, -0.5, 0.0, 0.25, 1.0)), 2.0) for s in range(30) for k, x in enumerate("abcdef") for y in "abcdef"[k + 1 :] if rng.random() < 0.2 + s / 40]
    rows += [(99, "a", "b", 1.0, 1.0), (99, "a", "c", 1.0, 1.0), (99, "a", "d", -1.0, 1.0)]
    edges = spark.createDataFrame(rows, "s int, i string, j string, margin double, support double")
    want = {tuple(r)[:5]: r[5] for r in cycles.margin_cycle_stats(edges, ["s"], 0.0).where("n_edges >= 3").collect()}
    got = {tuple(r)[:5]: r[5] for r in cycles.small_cycle_stats(edges, ["s"], 3).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items()) and (99, 3, 0, 0, None) in got
