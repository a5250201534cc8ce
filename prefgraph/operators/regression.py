"""Regressions from moments: fixed effects by demeaning or by dummies, sandwich errors, and coefficients of any number of resamples in one job.

A resample is a set of multiplicities, so its sums of products by cell of the factors are all that its coefficients need: rows are aggregated to cells with partial sums,
and each (key, resample) is solved from its cells, a few numbers. Factors with many levels are demeaned instead, one after the other until nothing is left to remove.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.functions.hashing import uniform
from prefgraph.functions.special import correlation_p, t_two_sided
from prefgraph.operators.ordering import _join, adjusted, average_ranks, kept, numbered, value_places
from prefgraph.operators.resample import stratified_permutation, times
from prefgraph.operators.scope_arrays import each
from prefgraph.operators.summaries import corr, finite

#: Spreads at or below this count as none, and a sample needs this many rows more than coefficients.
FLAT, SPARE = 1e-12, 3


def demeaned(rows: DataFrame, keys: list[str], factors: list[str], columns: list[str], weight: str | None = None, close: float = 1e-11, most: int = 500) -> DataFrame:
    """The columns less what the factors' levels explain of them: weighted means by each factor are taken away in turn until those of all
    factors are below ``close`` times the largest spread. Null is a level of its own. An error if ``most`` rounds don't do."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(w * F.col(c)), F.sum(w)), F.lit(0.0)).alias(f"_m_{c}")
    out = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    spread = max([v or 0.0 for v in out.agg(*[F.stddev_pop(c) for c in columns]).first()], default=0.0)
    for _ in range(most):
        for f in factors:
            out = _join(out, out.groupBy(*keys, f).agg(*[mean(c) for c in columns]), [*keys, f])
            out = out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
        out = kept(out, "demeaned")
        left = 0.0
        for f in factors[:-1]:
            left = max([left, *[v or 0.0 for v in out.groupBy(*keys, f).agg(*[mean(c) for c in columns]).agg(*[F.max(F.abs(f"_m_{c}")) for c in columns]).first()]])
        if left <= close * spread:
            return out
    raise ValueError(f"factors still explain {left} after {most} rounds")


def _standard(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """z-scores within keys, null where a column doesn't vary."""
    moments = rows.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    both = _join(rows, moments, keys) if keys else rows.join(F.broadcast(moments))  # one row
    z = lambda c: F.when(F.col(f"_sd_{c}") > FLAT, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}"))
    return both.withColumns({c: z(c) for c in columns}).drop(*[f"_{n}_{c}" for c in columns for n in ("mean", "sd")])


def fixed_effect_betas(rows: DataFrame, keys: list[str], y: str, xs: list[str], factors: list[str], weight: str | None = None) -> DataFrame:
    """keys, term, n, beta, se, low, high, p: standardised coefficients of y on xs with factors absorbed, and heteroscedasticity-consistent errors
    (a sandwich of moments, scaled for degrees of freedom; the interval is normal, p by Student's t). Columns that don't vary within keys
    are left out of a key's regression; no row for keys with too few rows."""
    columns = [y, *xs]
    z = finite(_standard(finite(rows, [*columns, *([weight] if weight else [])]), keys, columns).fillna(0.0, xs), columns)
    d = demeaned(z, keys, factors, columns, weight)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    levels = [F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).cast("double") for f in factors]
    sums = d.groupBy(*keys).agg(F.array(F.count("*").cast("double"), *levels, *[F.sum(w * F.col(a) * F.col(b)) for a, b in pairs]).alias("sums"))
    p = len(xs)

    def solve(sums):
        n, k = sums[0], 1 + p + sum(v - 1 for v in sums[1 : 1 + len(factors)])
        m = np.zeros((p + 1, p + 1))
        m[np.triu_indices(p + 1)] = sums[1 + len(factors) :]
        m = m + np.triu(m, 1).T
        use = np.flatnonzero(np.diag(m)[1:] > 1e-9 * n) + 1
        inverse, beta = np.zeros((p, p)), np.zeros(p)
        if n >= k + SPARE and len(use):
            inverse[np.ix_(use - 1, use - 1)] = np.linalg.pinv(m[np.ix_(use, use)], rcond=1e-12, hermitian=True)
            beta = inverse @ m[1:, 0]
        return {"n_rows": int(n), "df": float(n - k), "b": beta, "inverse": inverse.ravel()}

    solved = each(sums, keys, "n_rows long, df double, b array<double>, inverse array<double>", solve).where(F.col("df") >= SPARE)
    both = _join(d, solved, keys) if keys else d.join(F.broadcast(solved))
    error = F.col(y) - sum((F.get("b", F.lit(k)) * F.col(x) for k, x in enumerate(xs)), F.lit(0.0))
    xx = [(k, m) for k in range(p) for m in range(k, p)]
    meat = both.groupBy(*keys, "n_rows", "df", "b", "inverse").agg(F.array(*[F.sum(w * w * error * error * F.col(xs[k]) * F.col(xs[m])) for k, m in xx]).alias("meat"))

    def errors(n_rows, df, b, inverse, meat):
        a, m = inverse.reshape(p, p), np.zeros((p, p))
        m[np.triu_indices(p)] = meat
        v = a @ (m + np.triu(m, 1).T) @ a * n_rows / df
        fitted = np.diag(a) > 0
        return {"_rows": True, "term": xs, "n": [n_rows] * p, "beta": [float(x) if f else None for x, f in zip(b, fitted, strict=True)], "se": [float(np.sqrt(max(x, 0.0))) if f else None for x, f in zip(np.diag(v), fitted, strict=True)], "free": [df] * p}

    out = each(meat, keys, "term string, n long, beta double, se double, free double", errors)
    t = F.col("beta") / F.nullif(F.col("se"), F.lit(0.0))
    return out.select(*keys, "term", "n", "beta", "se", (F.col("beta") - 1.959963984540054 * F.col("se")).alias("low"), (F.col("beta") + 1.959963984540054 * F.col("se")).alias("high"), F.when(t.isNotNull(), t_two_sided(F.coalesce(t, F.lit(0.0)), F.col("free"))).alias("p"))


def within_correlation(rows: DataFrame, keys: list[str], x: str, y: str, cells: list[str]) -> DataFrame:
    """keys, n, r, p: correlation of what the cells' means leave of x and y; p with as many degrees less as there are cells."""
    d = demeaned(finite(rows, [x, y]), keys, ["_cell"], [x, y]) if "_cell" in rows.columns else demeaned(finite(rows, [x, y]).withColumn("_cell", F.to_json(F.struct(*cells))), keys, ["_cell"], [x, y])
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("_cell").alias("_c"), corr(x, y).alias("r"))
    return out.select(*keys, "n", "r", F.when(F.col("r").isNotNull(), correlation_p(F.coalesce("r", F.lit(0.0)), F.col("n") - F.col("_c") + 1)).alias("p"))


def dummy_betas(rows: DataFrame, keys: list[str], y: str, xs: list[str], factors: list[str], copies: str | None = None, weight: str | None = None) -> DataFrame:
    """keys, n, beta: the standardised coefficient of the first x, with the other xs and a dummy for each level of the factors but the first.

    ``copies``: how often a row counts (resamples); ``weight``: of a row in the fit, not in the standardisation. Null where y or the first x don't vary or
    rows are too few; other columns that don't vary are left out.
    """
    columns = [y, *xs]
    c = F.col(copies).cast("double") if copies else F.lit(1.0)
    w = c * F.col(weight).cast("double") if weight else c
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    sums = [F.sum(c), *[F.sum(c * F.col(v)) for v in columns], *[F.sum(c * F.col(v) * F.col(v)) for v in columns], F.sum(w), *[F.sum(w * F.col(v)) for v in columns], *[F.sum(w * F.col(a) * F.col(b)) for a, b in pairs]]
    level = [F.coalesce(F.col(f).cast("string"), F.lit("\0")).alias(f"_f{k}") for k, f in enumerate(factors)]
    cells = rows.groupBy(*keys, *level).agg(F.array(*sums).alias("_sums"))
    names = [f"_f{k}" for k in range(len(factors))]
    listed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names, "_sums"))).alias("_l"))
    listed = listed.select(*keys, *[F.col(f"_l.{n}").alias(f"level{k}") for k, n in enumerate(names)], F.flatten("_l._sums").alias("sums"))
    p = len(columns)

    def solve(sums, **levels):
        by = sums.reshape(-1, 2 + 3 * p + len(pairs))
        n, s1, s2 = by[:, 0].sum(), by[:, 1 : 1 + p].sum(axis=0), by[:, 1 + p : 1 + 2 * p].sum(axis=0)
        sd = np.sqrt(np.maximum(s2 / max(n, 1) - (s1 / max(n, 1)) ** 2, 0))
        base = by[:, 1 + 2 * p :]
        products = np.zeros((len(by), p + 1, p + 1))  # of 1, y, xs
        upper = np.triu_indices(p)
        products[:, 0, 0] = base[:, 0]
        products[:, 0, 1:] = products[:, 1:, 0] = base[:, 1 : 1 + p]
        products[:, upper[0] + 1, upper[1] + 1] = base[:, 1 + p :]
        products[:, upper[1] + 1, upper[0] + 1] = base[:, 1 + p :]
        masks = [np.array(levels[f"level{k}"]) == v for k in range(len(factors)) for v in sorted(set(levels[f"level{k}"]))[1:]]
        whole = products.sum(axis=0)
        used = [0, *[k + 1 for k in range(1, p) if sd[k] > FLAT]]
        size = len(used) + len(masks)
        if n < size + SPARE or sd[0] <= FLAT or sd[1] <= FLAT or base[:, 0].sum() <= 0:
            return {"n": int(n), "beta": None}
        g, rhs = np.zeros((size, size)), np.zeros(size)
        g[: len(used), : len(used)], rhs[: len(used)] = whole[np.ix_(used, used)], whole[used, 1]
        for k, mask in enumerate(masks):
            part = products[mask].sum(axis=0)
            at = len(used) + k
            g[at, : len(used)] = g[: len(used), at] = part[0, used]
            rhs[at] = part[0, 1]
            for m, other in enumerate(masks):
                g[at, len(used) + m] = products[mask & other, 0, 0].sum()
        scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        g, rhs = g * np.outer(scale, scale), rhs * scale
        try:
            low = np.linalg.cholesky(g)
            if np.diag(low).min() < 1e-7:
                raise np.linalg.LinAlgError
            beta = np.linalg.solve(low.T, np.linalg.solve(low, rhs))
        except np.linalg.LinAlgError:  # dependent columns
            beta = np.linalg.lstsq(g, rhs, rcond=1e-11)[0]
        return {"n": int(n), "beta": float(beta[1] * scale[1] * sd[1] / sd[0])}

    return each(listed, keys, "n long, beta double", solve)


def resampled(rows: DataFrame, keys: list[str], order: list[str], reps: int, seed: int) -> DataFrame:
    """rows drawn with replacement, as many as there are: keys, rep, the row's columns and _times. Rows are numbered in an order that is unique within
    keys; draws are numbers and meet the rows they name."""
    slots = kept(numbered(rows, order, "_slot", keys), "slots")
    sizes = slots.groupBy(*keys).agg(F.count("*").alias("_n"))
    draws = times(_join(slots.select(*keys, "_slot"), sizes, keys), "rep", reps)
    at = F.floor(uniform(seed, *[F.col(k) for k in keys], F.col("rep"), F.col("_slot")) * F.col("_n")).cast("long")
    drawn = draws.select(*keys, "rep", at.alias("_slot")).groupBy(*keys, "rep", "_slot").agg(F.count("*").alias("_times"))
    return kept(_join(drawn, slots, [*keys, "_slot"]).drop("_slot"), "resampled")


def weighted_spearman(rows: DataFrame, keys: list[str], x: str, y: str, copies: str) -> DataFrame:
    """keys, spearman of rows that count ``copies`` times; null for fewer than three or a column that doesn't vary."""
    ranked = average_ranks(rows.select(*keys, x, y, copies), keys, {x: "_rx", y: "_ry"}, copies=copies)
    c = F.col(copies).cast("double")
    n = F.sum(c)
    mean = lambda v: F.sum(c * v) / n
    a, b = F.col("_rx"), F.col("_ry")
    cov, va, vb = mean(a * b) - mean(a) * mean(b), mean(a * a) - mean(a) * mean(a), mean(b * b) - mean(b) * mean(b)
    fine = (n >= 3) & (F.max(x) - F.min(x) > FLAT) & (F.max(y) - F.min(y) > FLAT)
    return ranked.groupBy(*keys).agg(F.when(fine, F.try_divide(cov, F.sqrt(va * vb))).alias("spearman"))


def weighted_quartile_effect(rows: DataFrame, keys: list[str], x: str, y: str, copies: str) -> DataFrame:
    """keys, raw, std: mean of y at and above the third quartile of x less that at and below the first, rows counting ``copies`` times; and the same
    over y's spread. Null for fewer than eight."""
    places = value_places(rows, keys, x, copies=copies)
    sizes = rows.groupBy(*keys).agg(F.sum(copies).alias("_n"))
    both = _join(places, sizes, keys)
    # a value covers the ranks from _below on, _count of them
    reached = lambda k: F.min(F.when(F.col("_below") + F.col("_count") > k, F.col(x)))
    spot = lambda q: (F.col("_n") - 1) * F.lit(q)
    found = both.groupBy(*keys, "_n").agg(*[reached(f(spot(q))).alias(f"_{n}{m}") for q, m in ((0.25, "a"), (0.75, "b")) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    value = lambda m, q: F.col(f"_lo{m}") + (F.col(f"_hi{m}") - F.col(f"_lo{m}")) * (spot(q) - F.floor(spot(q)))
    cuts = found.select(*keys, "_n", value("a", 0.25).alias("_q1"), value("b", 0.75).alias("_q3"))
    c, v = F.col(copies).cast("double"), F.col(y)
    mean = lambda test: F.try_divide(F.sum(F.when(test, c * v)), F.sum(F.when(test, c)))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(c * v * v) / F.sum(c) - F.pow(F.sum(c * v) / F.sum(c), F.lit(2.0))))
    out = _join(rows, cuts, keys).groupBy(*keys, "_n").agg((mean(F.col(x) >= F.col("_q3")) - mean(F.col(x) <= F.col("_q1"))).alias("_d"), spread.alias("_sd"))
    fine = F.col("_n") >= 8
    return out.select(*keys, F.when(fine, F.col("_d")).alias("raw"), F.when(fine & (F.col("_sd") > FLAT), F.col("_d") / F.col("_sd")).alias("std"))


def intervals(rows: DataFrame, keys: list[str], values: list[str], reps: int) -> DataFrame:
    """keys and {value}_low, {value}_high: 95 percent intervals over resamples, null where too few resamples have a value."""
    least = max(30, reps // 20)
    enough = lambda v, q: F.when(F.count(v) >= least, F.percentile(v, q))
    return rows.groupBy(*keys).agg(*[enough(v, q).alias(f"{v}_{n}") for v in values for q, n in ((0.025, "low"), (0.975, "high"))])


def primary_effects(rows: DataFrame, x: str, y: str, controls: list[str], factors: list[str], key: str, reps: int, permutations: int, seed: int, least: int = 30, weight: str | None = None) -> DataFrame:
    """A row for each outcome: n, means, the partial coefficient of y on x with controls and factors, Spearman's correlation and the quartile effect, each with its
    interval over resampled rows; the permutation p of the coefficient (x dealt anew within factors, two-sided, add-one) and its q over outcomes.

    ``rows``: outcome, ``key`` (unique within outcome), x, y, controls, factors. Outcomes with fewer than ``least`` complete rows are left out.
    """
    o = ["outcome"]
    fine = finite(rows, [x, y, *controls])
    sizes = fine.groupBy(*o).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.stddev_pop(x).alias("sd_x"), F.avg(y).alias("mean_y")).where(F.col("n") >= least)
    base = kept(fine.join(sizes.select(*o), o, "left_semi").withColumn("_one", F.lit(1).cast("long")), "effects")
    xs = [x, *controls]
    beta = dummy_betas(base, o, y, xs, factors, None, weight).select(*o, "beta")
    plain = weighted_spearman(base, o, x, y, "_one").join(weighted_quartile_effect(base, o, x, y, "_one"), o)
    drawn, by = resampled(base.drop("_one"), o, [key], reps, seed), [*o, "rep"]
    draws = dummy_betas(drawn, by, y, xs, factors, "_times", weight).drop("n").join(weighted_spearman(drawn, by, x, y, "_times"), by, "left").join(weighted_quartile_effect(drawn, by, x, y, "_times"), by, "left")
    ends = intervals(draws, o, ["beta", "spearman", "raw", "std"], reps)
    dealt = stratified_permutation(base, [*o, *factors], key, x, permutations, seed).join(base.drop(x, "_one"), [*o, *factors, key])
    null = dummy_betas(dealt, by, y, xs, factors, None, weight).where("beta is not null").select(*by, F.col("beta").alias("_null"))
    p = null.join(beta, o).groupBy(*o).agg(((F.count_if(F.abs("_null") >= F.abs("beta") - 1e-12) + 1) / (F.count("*") + 1)).alias("permutation_p"))
    out = sizes.join(beta, o, "left").join(plain, o, "left").join(ends, o, "left").join(p, o, "left")
    out = out.withColumn("spearman_p", F.when(F.col("spearman").isNotNull(), correlation_p(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("spearman", F.lit(0.0)))), F.col("n"))))
    return adjusted(kept(out, "effects"), [], "permutation_p", "permutation_q")
