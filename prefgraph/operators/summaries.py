"""Statistical summaries of region, null and score tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefgraph.functions.special import correlation_p
from prefgraph.operators.ordering import adjusted, average_ranks, quantiles


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.where(ok)


def corr(x: str, y: str) -> Column:
    """Pearson's correlation, null where a column is constant (the built-in one divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def correlation(df: DataFrame, keys: list[str], x: str, y: str, nearly: bool = True) -> DataFrame:
    """keys, n, pearson, pearson_p, spearman, spearman_p: null for fewer than three rows or a column that is constant (``nearly``: or differs by 1e-8 and 1e-5 of its least
    value at most, whatever its scale). The p are two-sided, by Student's t."""
    ranked = average_ranks(finite(df, [x, y]).select(*keys, x, y), keys, {x: "_rx", y: "_ry"})
    flat = lambda c: F.max(c) - F.min(c) <= (1e-8 + 1e-5 * F.abs(F.min(c)) if nearly else F.lit(0.0))
    fine = (F.count("*") >= 3) & ~flat(x) & ~flat(y)
    both = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(fine, corr(x, y)).alias("pearson"), F.when(fine, corr("_rx", "_ry")).alias("spearman"))
    p = lambda r: F.when(F.col(r).isNotNull(), correlation_p(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(r))), F.col("n")))
    return both.select(*keys, "n", "pearson", p("pearson").alias("pearson_p"), "spearman", p("spearman").alias("spearman_p"))


def bh_q(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Adds the Benjamini-Hochberg q within keys; rows without p keep a null q and don't count."""
    return adjusted(df, keys, p, "q")


def p_plain(null: str, observed: Column) -> Column:
    """Share of null values at or above the observed one."""
    return F.avg((F.col(null) >= observed).cast("double"))


def p_add_one(null: str, observed: Column) -> Column:
    return (F.count_if(F.col(null) >= observed) + 1) / (F.count(null) + 1)


def p_floor(null: str, observed: Column) -> Column:
    """At least one over the number of null values."""
    return F.greatest(F.avg((F.col(null) >= observed).cast("double")), 1 / F.count(null))


def null_summary(df: DataFrame, keys: list[str], value: str, observed: str) -> DataFrame:
    """Mean, spread, quantiles, z and the three p-values of a null table that carries the observed value."""
    o = F.first(observed)
    obs = F.col(observed)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), o.alias("observed"), F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"), F.min(value).alias("null_min"), F.max(value).alias("null_max"), F.percentile(value, 0.025).alias("q025"), F.percentile(value, 0.5).alias("q500"), F.percentile(value, 0.975).alias("q975"),
        F.try_divide(o - F.avg(value), F.nullif(F.stddev_pop(value), F.lit(0.0))).alias("z"), p_plain(value, obs).alias("p_plain"), p_add_one(value, obs).alias("p_add_one"), p_floor(value, obs).alias("p_floor"),
    )


def calibrated_summary(df: DataFrame, keys: list[str], value: str, observed: str) -> DataFrame:
    """Observed value against null draws that carry it: mean, sample spread, quantiles, z (null without spread) and the add-one p.

    The draws of a key are as many as were asked for, so their exact percentiles fit a buffer.
    """
    o, mean, sd = F.first(observed), F.avg(value), F.stddev(value)
    ends = [F.percentile(value, q).alias(f"null_q{n}") for q, n in ((0.025, "025"), (0.5, "500"), (0.975, "975"))]
    return df.groupBy(*keys).agg(F.count(value).alias("n_draws"), o.alias("observed"), mean.alias("null_mean"), sd.alias("null_sd"), F.when(sd > 0, (o - mean) / sd).alias("z"), p_add_one(value, F.col(observed)).alias("p_ge"), *ends)


def quartile_effect(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mean of y in the highest quarter of x less that in the lowest; null for fewer than eight rows."""
    rows = finite(df, [x, y])
    cuts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev(y).alias("_sd")).join(quantiles(rows, keys, x, {"_lo": 0.25, "_hi": 0.75}), keys)
    both = rows.join(cuts, keys)
    high, low = F.avg(F.when(F.col(x) >= F.col("_hi"), F.col(y))), F.avg(F.when(F.col(x) <= F.col("_lo"), F.col(y)))
    return both.groupBy(*keys, "n", "_sd").agg((high - low).alias("_d")).select(*keys, "n", F.when(F.col("n") >= 8, F.col("_d")).alias("effect"), F.when(F.col("n") >= 8, F.try_divide("_d", F.nullif(F.col("_sd"), F.lit(0.0)))).alias("effect_sd"))


def histogram(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Counts per bin; Freedman-Diaconis bins, 12 to 40, or 20 if the middle half is constant."""
    middle = quantiles(df, keys, x, {"_q1": 0.25, "_q3": 0.75}).select(*keys, (F.col("_q3") - F.col("_q1")).alias("_iqr"))
    per = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("_n")).join(middle, keys)
    wide = 2 * F.col("_iqr") / F.pow(F.col("_n"), F.lit(1 / 3))
    bins = F.when(F.col("_iqr") <= 0, F.lit(20)).otherwise(F.greatest(F.lit(12), F.least(F.lit(40), F.ceil((F.col("hi") - F.col("lo")) / wide)))).cast("int")
    rows = df.join(per.withColumn("bins", bins), keys)
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.col("bins") - 1, F.floor(F.round((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"), 9)))).otherwise(F.lit(0)).cast("int")
    return rows.groupBy(*keys, "bins", at.alias("bin")).agg(F.count("*").alias("n"))


def marked_histogram(df: DataFrame, keys: list[str], value: str, observed: str) -> DataFrame:
    """Bins of null draws that carry the observed value: lower edge, count, whether the observed value lies in the bin (at the ends also beyond it), and for reports the
    share of draws at or above it, or the bound 1 / (n + 1) where there is none."""
    per = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first(observed).alias("observed"), F.avg((F.col(value) >= F.col(observed)).cast("double")).alias("_p"), F.count(value).alias("_n"))
    rows = histogram(df, keys, value).join(per, keys)
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    at = F.when(width > 0, F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor((F.col("observed") - F.col("_lo")) / width)))).otherwise(F.lit(0))
    return rows.select(*keys, "bins", "bin", (F.col("_lo") + F.col("bin") * width).alias("edge"), "n", (F.col("bin") == at).alias("marked"), F.when(F.col("_p") > 0, F.col("_p")).otherwise(1 / (F.col("_n") + 1)).alias("p"), (F.col("_p") == 0).alias("p_is_bound"))


def z_scores(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds z_ columns by the mean and spread within keys, which are made by partial sums and joined."""
    moments = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    out = df.join(moments, keys).withColumns({f"z_{c}": F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.nullif(F.col(f"_sd_{c}"), F.lit(0.0))) for c in columns})
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("mean", "sd")])


def partial_beta(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Standardised coefficients of y on xs, from the correlations of a scope, a row each; null if a column is constant."""
    cols = [y, *xs]
    rows = finite(df, cols)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.coalesce(corr(a, b), F.lit(float("nan"))) for a in cols for b in cols]).alias("_r"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf["_r"]:
                m = np.array(r, float).reshape(len(cols), len(cols))
                try:
                    out.append(list(np.linalg.solve(m[1:, 1:], m[1:, 0])) if np.isfinite(m).all() else [None] * len(xs))
                except np.linalg.LinAlgError:
                    out.append([None] * len(xs))
            yield pd.concat([pdf.drop(columns="_r").reset_index(drop=True), pd.DataFrame(out, columns=[f"beta_{x}" for x in xs])], axis=1)

    return sums.mapInPandas(solve, f"{kinds}, n long, " + ", ".join(f"`beta_{x}` double" for x in xs))
