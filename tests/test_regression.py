"""Regressions from moments against plain least squares with dummies, resampled statistics against plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefgraph.operators import ordering, regression

FACTORS = ["g", "a"]


def frame(seed=0, n=300):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"outcome": rng.choice(["u", "v"], n), "region": [f"r{k:04d}" for k in range(n)], "g": rng.choice(["x", "y"], n), "a": rng.choice(["p", "q", "r", "s"], n, p=[0.6, 0.2, 0.15, 0.05])})
    level = df["g"].map({"x": 1.0, "y": -2.0}) + df["a"].map({"p": 0.0, "q": 3.0, "r": 1.0, "s": -4.0})
    df["c1"] = rng.normal(size=n) + level
    df["c2"] = rng.exponential(size=n)
    df["x"] = np.round(0.5 * df["c1"] + level + rng.normal(size=n), 1)
    df["y"] = 0.3 * df["x"] - df["c2"] + 2 * level + rng.normal(size=n) * (1 + df["c2"])
    df["flat"], df["w"], df["times"] = 7.0, rng.integers(1, 9, n).astype(float), rng.integers(0, 4, n)
    return df


def z(v):
    return (v - v.mean()) / v.std() if v.std() > 1e-12 else v * 0


def design(d, xs, factors):
    cols = [np.ones(len(d))] + [z(d[c].to_numpy()) for c in xs if d[c].std(ddof=0) > 1e-12]
    for f in factors:
        cols += [(d[f] == level).to_numpy(float) for level in sorted(d[f].unique())[1:]]
    return np.column_stack(cols)


def plain_beta(d, xs, factors, weight=None):
    if d["y"].std(ddof=0) <= 1e-12 or d[xs[0]].std(ddof=0) <= 1e-12:
        return None
    m, y = design(d, xs, factors), z(d["y"].to_numpy())
    if len(d) < m.shape[1] + 3:
        return None
    root = np.ones(len(d)) if weight is None else np.sqrt(d[weight].to_numpy())
    return np.linalg.lstsq(m * root[:, None], y * root, rcond=None)[0][1]


@pytest.mark.parametrize("weight", [None, "w"])
def test_dummy_betas_equal_plain_ols(spark, weight):
    df = frame()
    few = df.head(6).assign(outcome="few")
    const = df.head(40).assign(outcome="const", x=3.0)
    both = pd.concat([df, few, const])
    xs = ["x", "c1", "c2", "flat"]
    got = {r["outcome"]: r["beta"] for r in regression.dummy_betas(spark.createDataFrame(both), ["outcome"], "y", xs, FACTORS, None, weight).collect()}
    for o, d in both.groupby("outcome"):
        want = plain_beta(d, xs, FACTORS, weight)
        assert got[o] == (None if want is None else pytest.approx(want, rel=1e-9))
    copied = {r["outcome"]: r["beta"] for r in regression.dummy_betas(spark.createDataFrame(df), ["outcome"], "y", xs, FACTORS, "times", weight).collect()}
    for o, d in df.groupby("outcome"):
        assert copied[o] == pytest.approx(plain_beta(d.loc[d.index.repeat(d["times"])], xs, FACTORS, weight), rel=1e-9)


def test_dependent_columns(spark):
    df = frame().assign(c3=lambda d: 2 * d["c1"] - 1, h=lambda d: d["g"])
    got = {r["outcome"]: r["beta"] for r in regression.dummy_betas(spark.createDataFrame(df), ["outcome"], "y", ["x", "c1", "c3"], ["g", "a", "h"]).collect()}
    for o, d in df.groupby("outcome"):
        assert got[o] == pytest.approx(plain_beta(d, ["x", "c1"], FACTORS), rel=1e-7)


@pytest.mark.parametrize("weight", [None, "w"])
def test_fixed_effects_equal_dummies(spark, weight):
    """Two crossed, unbalanced factors, one with many levels: coefficients and sandwich errors of the regression with all dummies."""
    df = frame(3, 400)
    df["a"] = [f"l{k}" for k in np.random.default_rng(1).integers(0, 30, len(df))]
    xs = ["x", "c1", "c2"]
    rows = spark.createDataFrame(pd.concat([df, df.head(3).assign(y=float("nan"))])).withColumn("a", F.when(F.col("a") == "l7", F.lit(None)).otherwise(F.col("a")))
    got = {(r["outcome"], r["term"]): r for r in regression.fixed_effect_betas(rows, ["outcome"], "y", xs, FACTORS, weight).collect()}
    for o, d in df.groupby("outcome"):
        m, y = design(d, xs, FACTORS), z(d["y"].to_numpy())
        w = np.ones(len(d)) if weight is None else d[weight].to_numpy()
        inverse = np.linalg.pinv(m.T @ (m * w[:, None]))
        beta = inverse @ m.T @ (w * y)
        e = y - m @ beta
        v = inverse @ (m.T @ (m * (w * e)[:, None] ** 2)) @ inverse * len(d) / (len(d) - m.shape[1])
        for k, term in enumerate(xs):
            r = got[o, term]
            assert r["n"] == len(d) and r["beta"] == pytest.approx(beta[k + 1], rel=1e-7) and r["se"] == pytest.approx(np.sqrt(v[k + 1, k + 1]), rel=1e-6)
            assert r["low"] < r["beta"] < r["high"] and 0 <= r["p"] <= 1
    assert regression.fixed_effect_betas(rows.limit(0), ["outcome"], "y", xs, FACTORS).count() == 0


def test_within_correlation(spark):
    df = frame(5)
    got = {r["outcome"]: r for r in regression.within_correlation(spark.createDataFrame(df), ["outcome"], "x", "y", FACTORS).collect()}
    for o, d in df.groupby("outcome"):
        centred = d[["x", "y"]] - d.groupby(FACTORS)[["x", "y"]].transform("mean")
        assert got[o]["r"] == pytest.approx(centred.corr().iloc[0, 1], rel=1e-9) and got[o]["n"] == len(d)


def repeated(d):
    return d.loc[d.index.repeat(d["times"])]


def test_statistics_of_copies(spark):
    df = frame(6)
    rows = spark.createDataFrame(df.assign(times=df["times"].astype("int64")))
    rho = {r["outcome"]: r["spearman"] for r in regression.weighted_spearman(rows.where("times > 0"), ["outcome"], "x", "y", "times").collect()}
    effect = {r["outcome"]: r for r in regression.weighted_quartile_effect(rows.where("times > 0"), ["outcome"], "x", "y", "times").collect()}
    for o, d in df.groupby("outcome"):
        d = repeated(d)
        assert rho[o] == pytest.approx(d["x"].rank().corr(d["y"].rank()), rel=1e-9)
        raw = d[d["x"] >= d["x"].quantile(0.75)]["y"].mean() - d[d["x"] <= d["x"].quantile(0.25)]["y"].mean()
        assert effect[o]["raw"] == pytest.approx(raw, rel=1e-9) and effect[o]["std"] == pytest.approx(raw / d["y"].std(ddof=0), rel=1e-9)


def test_resamples_are_whole_and_repeat(spark):
    df = spark.createDataFrame(frame(7).drop(columns="times"))
    a, b = (regression.resampled(x, ["outcome"], ["region"], 12, 5).select("outcome", "rep", "region", "_times").toPandas() for x in (df, df.repartition(6)))
    key = lambda t: t.sort_values(["outcome", "rep", "region"]).reset_index(drop=True)
    assert key(a).equals(key(b))
    sizes = frame(7).groupby("outcome").size()
    assert all(v == sizes[o] for (o, _), v in a.groupby(["outcome", "rep"])["_times"].sum().items())


def test_primary_effects(spark):
    df = frame(8).drop(columns=["times"])
    df.loc[df.index[:20], "outcome"] = "few"
    out = {r["outcome"]: r for r in regression.primary_effects(spark.createDataFrame(df), "x", "y", ["c1", "c2"], FACTORS, "region", 60, 60, 3).collect()}
    assert set(out) == {"u", "v"}
    for o, r in out.items():
        d = df[df["outcome"] == o]
        assert r["n"] == len(d) and r["beta"] == pytest.approx(plain_beta(d, ["x", "c1", "c2"], FACTORS), rel=1e-9)
        assert r["beta_low"] < r["beta"] < r["beta_high"] and r["spearman_low"] < r["spearman"] < r["spearman_high"] and r["raw_low"] < r["raw"] < r["raw_high"]
        assert 1 / 61 <= r["permutation_p"] <= 1 and r["permutation_p"] <= r["permutation_q"] <= 1
    qs = sorted((r["permutation_p"], r["permutation_q"]) for r in out.values())
    assert qs[1][1] == pytest.approx(qs[1][0]) and qs[0][1] == pytest.approx(min(2 * qs[0][0], qs[1][0]))


def test_intervals_need_enough_resamples(spark):
    rows = spark.createDataFrame([("a", float(k) if k < 29 else None) for k in range(100)] + [("b", float(k)) for k in range(100)], "o string, v double")
    got = {r["o"]: r for r in regression.intervals(rows, ["o"], ["v"], 100).collect()}
    assert got["a"]["v_low"] is None and got["b"]["v_low"] == pytest.approx(np.percentile(range(100), 2.5))
    assert ordering.kept(rows, "t").count() == 200
