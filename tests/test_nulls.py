"""Bounded projections against all active sets, binomial draws against their law, null statistics against the native operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefgraph.functions.draws import binomials, mixed
from prefgraph.operators import cycles, null_draws, projection, resample, summaries
from prefgraph.operators.projection_bounded import _with_equations, bounded_scores, projection_bounded, scores_of
from prefgraph.operators.scope_arrays import incidence, solver


def best_of_all(a, b, m, w, n, bound):
    """The least loss over every choice of edges at either bound."""
    edges, best = incidence(a, b, n), math.inf
    for side in itertools.product((-1.0, 0.0, 1.0), repeat=len(m)):
        side = np.array(side)
        r = _with_equations(edges, w, m, side != 0, side, bound)[0] if side.any() else solver(edges, w) @ m
        f = edges @ r
        if np.abs(f).max() <= bound + 1e-9:
            best = min(best, float((w * (f - m) ** 2).sum()))
    return best


def test_bounded_scores_are_optimal():
    rng = np.random.default_rng(1)
    bound_hit = 0
    for trial in range(60):
        n = int(rng.integers(2, 5))
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.85] or [(0, 1)]
        a, b = np.array(pairs).T
        m, w = np.clip(rng.normal(0, 1.2, len(a)), -1, 1), rng.integers(1, 50, len(a)).astype(float)
        m = np.sign(m) if trial % 5 == 0 else m
        bound = 0.999 if trial % 2 else 0.4
        r, residual, _ = bounded_scores(a, b, m, w, n, bound)
        f = r[a] - r[b]
        bound_hit += np.abs(f).max() > bound - 1e-9
        assert residual < 1e-9 and abs(r.mean()) < 1e-12 and np.abs(f).max() <= bound + 1e-9
        assert (w * (f - m) ** 2).sum() == pytest.approx(best_of_all(a, b, m, w, n, bound), rel=1e-9, abs=1e-12)
    assert bound_hit > 15


def test_clipping_is_another_optimum(spark):
    """A chain whose free fit passes the bound: the bounded fit has less loss than the clipped one; both scopes in one job."""
    chain = [("a", "b", 0.9, 10.0), ("b", "c", 0.9, 10.0), ("a", "c", 1.0, 1.0)]
    mild = [("x", "y", 0.1, 3.0), ("y", "z", 0.2, 3.0), ("x", "z", 0.2, 3.0)]
    flow = spark.createDataFrame([("hard", *r) for r in chain] + [("mild", *r) for r in mild] + [("mild", "x", "q", 0.5, 0.0)], "scope string, i string, j string, margin double, support double")
    got = {r["scope"]: r for r in projection_bounded(flow, ["scope"]).collect()}
    hard = got["hard"]
    assert hard["n_at_bound"] == 1 and hard["max_abs_fitted"] == pytest.approx(0.999) and hard["kkt_residual"] < 1e-9
    free = solver(incidence(np.array([0, 1, 0]), np.array([1, 2, 2]), 3), np.array([10.0, 10.0, 1.0])) @ np.array([0.9, 0.9, 1.0])
    clipped = np.clip([free[0] - free[1], free[1] - free[2], free[0] - free[2]], -0.999, 0.999)
    assert not np.allclose(clipped[0] + clipped[1], clipped[2])  # clipped margins aren't differences of any scores
    assert hard["scores"][0] - hard["scores"][1] == pytest.approx(0.4995)
    mild_row = got["mild"]
    plain = projection.graph_projection(flow.where("scope = 'mild' and support > 0"), ["scope"], 200).first()
    assert mild_row["n_at_bound"] == 0 and mild_row["residual_energy"] == pytest.approx(plain["residual_energy"], abs=1e-9) and mild_row["nodes"] == ["x", "y", "z"]
    assert {(r["scope"], r["node"]) for r in scores_of(projection_bounded(flow, ["scope"]), ["scope"]).collect()} == {("hard", x) for x in "abc"} | {("mild", x) for x in "xyz"}


@pytest.mark.parametrize("n, p", [(1, 0.3), (7, 0.5), (30, 0.02), (25, 0.5), (1000, 0.01), (1000, 0.3), (10**6, 0.7), (10**9, 1e-9)])
def test_binomial_law(n, p):
    """Mean and variance of a hundred thousand draws, and for small n all frequencies."""
    size = 100_000
    keys = mixed(np.arange(size, dtype=np.uint64) + np.uint64(n))
    x = binomials(keys, np.full(size, n), np.full(size, p))
    sd = math.sqrt(n * p * (1 - p))
    assert abs(x.mean() - n * p) < 4.5 * sd / math.sqrt(size) and abs(x.var() / sd**2 - 1) < 0.05 and x.min() >= 0 and x.max() <= n
    assert np.array_equal(x, binomials(keys, np.full(size, n), np.full(size, p)))
    assert np.array_equal(binomials(keys[::-1], np.full(size, n), np.full(size, p)), x[::-1])
    if n <= 30:
        seen = np.bincount(x, minlength=n + 1) / size
        law = np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert np.abs(seen - law).max() < 5 * math.sqrt(0.25 / size)


def test_binomial_edges(spark):
    keys = mixed(np.arange(4, dtype=np.uint64))
    assert binomials(keys, np.array([5, 5, 0, 0]), np.array([0.0, 1.0, 0.5, 1.5])).tolist() == [0, 5, 0, 0]
    rows = spark.range(2000).select("id", F.lit(40).cast("long").alias("n"), F.lit(0.25).alias("p"))
    one, two = ({r["id"]: r["wins"] for r in resample.binomial(df, "n", "p", [F.col("id")], 3).collect()} for df in (rows, rows.repartition(5)))
    assert one == two and abs(sum(one.values()) / 2000 - 10) < 0.4


@pytest.fixture(scope="module")
def flow(spark):
    rng = np.random.default_rng(4)
    rows = [(s, x, y, float(round(rng.uniform(-1, 1), 3)), float(rng.integers(1, 12))) for s in ("p", "q", "r") for x, y in itertools.combinations("abcdefg", 2) if rng.random() < 0.8]
    rows += [("zero", "a", "b", 0.0, 3.0), ("pair", "a", "b", 0.5, 9.0)]
    return spark.createDataFrame(rows, "scope string, i string, j string, margin double, support double")


@pytest.mark.parametrize("least, tau", [(0.0, 0.0), (4.0, 0.2)])
def test_statistics_equal_the_native_ones(flow, least, tau):
    got = {r["scope"]: r for r in null_draws.observed_stats(flow, ["scope"], least, tau).collect()}
    want = {r["scope"]: r for r in cycles.margin_cycle_stats(flow, ["scope"], least, tau).collect()}
    rho = {r["scope"]: r["rho"] for r in projection.graph_projection(flow.where(F.col("support") >= least), ["scope"], 400).collect()}
    for s, r in got.items():
        assert (r["eligible_triples"], r["cyclic_triples"]) == ((want[s]["eligible"], want[s]["cyclic"]) if s in want else (0, 0))
        assert r["cycle_rate"] == (want[s]["cycle_rate"] if s in want else None)
        assert r["rho"] == (pytest.approx(rho[s], abs=1e-7) if rho.get(s) is not None else None)


def test_null_draws_keep_supports_and_follow_scores(spark, flow):
    cells = flow.select("scope", "i", "j", F.explode(F.array(F.lit(1.0), F.lit(0.5))).alias("weight"), (F.col("support") * 20).cast("long").alias("n"))
    fit = projection_bounded(flow, ["scope"])
    run = lambda **more: {(r["scope"], r["rep"]): (None if r["rho"] is None else round(r["rho"], 12), *tuple(r)[3:]) for r in null_draws.null_stats(cells, fit, ["scope"], 130, 7, **more).collect()}
    first = run()
    assert first == run(block=33) and len(first) == 5 * 130
    other = {(r["scope"], r["rep"]): r["rho"] for r in null_draws.null_stats(cells, fit, ["scope"], 130, 8).collect()}
    assert sum(other[k] != pytest.approx(first[k][0]) for k in first if k[0] in "pqr") > 380
    # many observations: draws come near the additive margins, whose residual is 0
    many = cells.withColumn("n", F.col("n") * 100_000)
    rho = [r["rho"] for r in null_draws.null_stats(many.where("scope in ('p', 'q', 'r')"), fit, ["scope"], 20, 7).collect()]
    assert len(rho) == 60 and max(rho) < 1e-3
    wrong = fit.withColumn("nodes", F.transform("nodes", lambda x: F.concat(x, x)))
    with pytest.raises(Exception, match="other alternatives"):
        null_draws.null_stats(cells, wrong, ["scope"], 3, 7).count()


def test_calibrated_summary(spark):
    rows = spark.createDataFrame([("a", float(v), 3.0) for v in (1, 2, 3, 4)] + [("flat", 2.0, 2.0)] * 3, "k string, v double, o double")
    got = {r["k"]: r for r in summaries.calibrated_summary(rows, ["k"], "v", "o").collect()}
    assert got["a"]["p_ge"] == pytest.approx(3 / 5) and got["a"]["null_sd"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1)) and got["a"]["null_q025"] == pytest.approx(np.quantile([1, 2, 3, 4], 0.025))
    assert got["flat"]["z"] is None and got["flat"]["p_ge"] == 1.0
