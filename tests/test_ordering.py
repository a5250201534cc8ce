"""Numbers, ranks, q-values and quantiles of many rows, and special functions, against numpy and closed forms."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefgraph.functions import special
from prefgraph.operators import ordering, summaries

MANY = 2_000_000


def test_two_million_rows_are_numbered_alike_twice(spark):
    """Scattered keys with a carried column, several ranges; the number is the key's place, twice alike."""
    rows = spark.range(MANY).select(((F.col("id") * 1_000_003) % MANY * 3).alias("k"), F.concat(F.lit("carried "), F.col("id")).alias("text")).repartition(7)
    first = ordering.numbered(rows, "k", "n", rows_a_range=150_000)
    again = ordering.numbered(rows, "k", "n", rows_a_range=150_000)
    for out in (first, again):
        got = out.agg(F.count("*").alias("rows"), F.count_distinct("n").alias("distinct"), F.max("n").alias("most"), F.count_if(F.col("n") * 3 != F.col("k")).alias("wrong"), F.count_distinct("text").alias("texts")).first()
        assert got.asDict() == {"rows": MANY, "distinct": MANY, "most": MANY - 1, "wrong": 0, "texts": MANY}


def test_numbers_within_keys(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 2, F.lit(None)).otherwise(F.col("id") % 3).alias("h"), (5000 - F.col("id")).alias("k"))
    got = ordering.numbered(rows, ["k"], "n", ["h"], ranges=9).collect()
    for h in (0, 1, None):
        mine = sorted((r["k"], r["n"]) for r in got if r["h"] == h)
        assert [n for _, n in mine] == list(range(1000))
    assert ordering.numbered(rows.limit(0), "k", "n").count() == 0


def ranks(x):
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    return (upto - (counts - 1) / 2)[inverse]


def test_a_million_ranks_in_one_scope(spark):
    """A third of all rows share one value; no window partition of the plan is a whole scope."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("all").alias("g"), "id", F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.round(F.rand(5), 5)).alias("x"), F.rand(6).alias("y"))
    rows = ordering.kept(rows, "test")
    got = ordering.average_ranks(rows, ["g"], {"x": "rx"}, rows_a_range=9_000).toPandas()
    assert len(got) == n and np.array_equal(got["rx"].to_numpy(), ranks(got["x"].to_numpy()))
    corr = summaries.correlation(rows, ["g"], "x", "y").first()
    x, y = got["x"].to_numpy(), got["y"].to_numpy()
    assert corr["n"] == n and corr["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9) and corr["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9)


def plain_q(p):
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def test_a_million_q_values(spark):
    rows = ordering.kept(spark.range(1_000_000).select(F.lit(1).alias("g"), "id", F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 4 == 0, F.lit(0.03)).otherwise(F.round(F.pow(F.rand(9), F.lit(3.0)), 6)).alias("p")), "test")
    got = ordering.adjusted(rows, ["g"], "p", rows_a_range=20_000).toPandas()
    there = got["p"].notna()
    assert len(got) == 1_000_000 and got["q"].isna().equals(got["p"].isna())
    assert np.allclose(got["q"][there], plain_q(got["p"][there].to_numpy()), rtol=1e-12)
    small = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03), (1, 0.2), (2, 0.5), (None, 0.9), (None, None)], "g int, p double")
    assert sorted((str(r["g"]), str(r["p"]), None if r["q"] is None else round(r["q"], 6)) for r in ordering.adjusted(small, ["g"], "p", ranges=3).collect()) == [("1", "0.01", 0.04), ("1", "0.03", 0.053333), ("1", "0.04", 0.053333), ("1", "0.2", 0.2), ("2", "0.5", 0.5), ("None", "0.9", 0.9), ("None", "None", None)]
    assert ordering.adjusted(small.drop("g"), [], "p", ranges=2).where("p = 0.01").first()["q"] == pytest.approx(0.06)


WANTED = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.9999, "f": 1.0}


@pytest.mark.parametrize("inside, accuracy", [(200_000, 5_000), (40, 20)])
def test_quantiles_are_exact(spark, inside, accuracy):
    """Smooth, tied, skewed and tiny groups; small sketches and brackets force several rounds."""
    shape = F.when(F.col("g") == 0, F.rand(1)).when(F.col("g") == 1, F.floor(F.rand(2) * 4)).when(F.col("g") == 2, F.pow(F.lit(10.0), F.rand(3) * 300)).when(F.col("g") == 3, F.lit(7.0)).otherwise(-F.col("id"))
    sizes = spark.range(20_000).select("id", F.least(F.col("id") % 5, F.when(F.col("id") < 20, F.lit(9)).otherwise(F.lit(4))).alias("g"))
    rows = ordering.kept(sizes.withColumn("x", shape.cast("double")).unionByName(spark.createDataFrame([(1, 77, 3.0), (2, 78, None)], "id long, g long, x double")), "test")
    got = {r["g"]: r for r in ordering.quantiles(rows, ["g"], "x", WANTED, inside, accuracy).collect()}
    have = rows.where("x is not null").toPandas().groupby("g")["x"]
    assert set(got) == set(have.groups)
    for g, x in have:
        for name, p in WANTED.items():
            assert got[g][name] == pytest.approx(np.quantile(x.to_numpy(), p), rel=1e-12), (g, name)
    one = ordering.quantiles(rows, [], "x", {"m": 0.5}, inside, accuracy).first()
    assert one["m"] == pytest.approx(rows.toPandas()["x"].dropna().median(), rel=1e-12)
    assert ordering.quantiles(rows.limit(0), ["g"], "x", WANTED).count() == 0


def test_quantile_plans_hold_no_group_in_a_buffer(spark):
    """Attribute summaries and quartile effects sort no group's values in one aggregate."""
    from prefgraph.operators import attributes

    rows = spark.range(100).selectExpr("id as conversation_id", "id % 7 as user_id", "'a' as attribute", "cast(id as double) as value")
    plan = attributes.attribute_summary(rows)._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan
    got = attributes.attribute_summary(rows).first()
    assert (got["q25"], got["q50"], got["q75"], got["n_high"], got["n_low"]) == (24.75, 49.5, 74.25, 25, 25)


def exact_share(a, b, x):
    """I_x(a, b) of whole a and b, as a binomial tail."""
    n, x = a + b - 1, Fraction(x)
    return float(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)))


def t_tail(r, df):
    """Two-sided p of a correlation with whole degrees of freedom: finite sums."""
    c2 = 1 - r * r
    if df % 2 == 0:
        term, total = 1.0, 0.0
        for k in range(df // 2):
            total += term
            term *= (2 * k + 1) / (2 * k + 2) * c2
        return 1 - abs(r) * total
    term, total = 1.0, 0.0
    for k in range((df - 1) // 2):
        total += term
        term *= (2 * k + 2) / (2 * k + 3) * c2
    return 1 - 2 / math.pi * (math.asin(abs(r)) + abs(r) * math.sqrt(c2) * total)


def test_incomplete_beta(spark):
    cases = [(a, b, x) for a in (1, 2, 7, 60, 400) for b in (1, 3, 25, 300) for x in (0.001, 0.2, 0.5, 0.77, 0.999)] + [(3, 4, 0.0), (3, 4, 1.0)]
    df = spark.createDataFrame([(float(a), float(b), float(x)) for a, b, x in cases], "a double, b double, x double")
    got = {(r["a"], r["b"], r["x"]): r for r in df.select("*", special.beta_share(F.col("a"), F.col("b"), F.col("x")).alias("v"), special.log_gamma(F.col("a")).alias("g")).collect()}
    for a, b, x in cases:
        r = got[float(a), float(b), float(x)]
        assert r["v"] == pytest.approx(exact_share(a, b, x), rel=1e-10, abs=1e-300)
        assert r["g"] == pytest.approx(math.lgamma(a), rel=1e-13, abs=1e-13)


def test_correlation_p(spark):
    cases = [(r, n) for n in (3, 4, 5, 12, 31, 200, 1001, 40_000) for r in (-1.0, -0.9, -0.3, 0.0, 0.001, 0.05, 0.6, 0.9999)]
    df = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long")
    got = {(r["r"], r["n"]): r["p"] for r in df.select("*", special.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()}
    for r, n in cases:
        assert got[float(r), n] == pytest.approx(t_tail(r, n - 2), abs=1e-9)
    assert spark.range(1).select(special.correlation_p(F.lit(0.5), F.lit(2)).alias("p")).first()["p"] is None
    # far tails keep their relative accuracy: df = 1 has a closed form
    tail = spark.range(1).select(special.t_two_sided(F.lit(1e8), F.lit(1)).alias("p")).first()["p"]
    assert tail == pytest.approx(2 / math.pi * math.atan(1e-8), rel=1e-10)


def test_correlation_guards(spark):
    rows = spark.createDataFrame([("few", 1.0, 2.0), ("few", 2.0, 3.0)] + [("flat", 5.0, float(k)) for k in range(9)] + [("nearly", 1 + k * 1e-7, float(k)) for k in range(9)] + [("line", float(k), 2.0 * k) for k in range(9)] + [("line", float("nan"), 1.0), ("line", None, 1.0)], "g string, x double, y double")
    got = {r["g"]: r for r in summaries.correlation(rows, ["g"], "x", "y").collect()}
    assert all(got[g][c] is None for g in ("few", "flat", "nearly") for c in ("pearson", "spearman", "pearson_p", "spearman_p"))
    assert got["line"]["n"] == 9 and got["line"]["pearson"] == pytest.approx(1) and got["line"]["pearson_p"] < 1e-9


def test_correlation_of_tiny_differences(spark):
    """Sizes a few billionths apart: without ``nearly`` they have the correlations that SQL gives, constant ones still none."""
    rows = [("tiny", float(k), 1e-9 * (k % 3)) for k in range(9)] + [("flat", float(k), 3e-9) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in summaries.correlation(df, ["g"], "x", "y", nearly=False).collect()}
    x, y = [float(k) for k in range(9)], [k % 3 for k in range(9)]
    assert got["tiny"]["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["tiny"]["spearman"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and 0 < got["tiny"]["pearson_p"] < 1
    assert got["flat"]["pearson"] is None and got["flat"]["spearman"] is None
    assert all(r["pearson"] is None for r in summaries.correlation(df, ["g"], "x", "y").collect())
