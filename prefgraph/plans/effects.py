"""Effects of the residual on held-out losses of regions: the primary table, within-group correlations and fixed-effect coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.operators import ordering, regions, regression, summaries
from prefgraph.plans import inference, models
from prefgraph.sources.fixtures import ASPECTS

BOOTSTRAPS, PERMUTATIONS, SEED = 500, 1000, 1009
CONTROLS = ["mean_abs_margin", "min_support", "log_weight"]
FACTORS = ["scope", "aspect"]


def effect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each outcome and region, averaged over splits: rho, the outcome, controls."""
    columns = ["rho", "mean_abs_margin", "min_support", "total_weight", *models.OUTCOMES]
    means = regions.region_means(models.region_table(spark, sf_dir), columns)
    means = means.select(*FACTORS, F.concat_ws("|", "scope", "aspect", "i", "j", "k").alias("region"), *[F.round(c, 9).alias(c) for c in columns if c != "total_weight"], F.round(F.log1p("total_weight"), 9).alias("log_weight"))
    long = means.unpivot([*FACTORS, "region", "rho", *CONTROLS], models.OUTCOMES, "outcome", "y")
    return ordering.kept(long, "effect-rows")


def primary(spark, sf_dir):
    """The primary effects table: partial coefficient, Spearman and quartile effect with intervals, permutation p and q, by outcome."""
    out = regression.primary_effects(effect_rows(spark, sf_dir), "rho", "y", CONTROLS, FACTORS, "region", BOOTSTRAPS, PERMUTATIONS, SEED)
    return out.withColumns({c: F.round(c, 5) + 0.0 for c, kind in out.dtypes if kind == "double"})


def within(spark, sf_dir):
    """Aggregate correlation, correlation within scope and aspect, and the fixed-effect coefficient with its sandwich interval, by outcome."""
    rows, o = effect_rows(spark, sf_dir), ["outcome"]
    whole = summaries.correlation(rows, o, "rho", "y").select(*o, F.col("pearson").alias("aggregate_pearson"), F.col("spearman").alias("aggregate_spearman"))
    inner = regression.within_correlation(rows, o, "rho", "y", FACTORS).select(*o, "n", F.col("r").alias("within_r"), F.col("p").alias("within_p"))
    fixed = regression.fixed_effect_betas(rows, o, "y", ["rho", *CONTROLS], FACTORS).where("term = 'rho'").select(*o, F.col("beta").alias("fe_beta"), F.col("low").alias("fe_low"), F.col("high").alias("fe_high"), F.col("p").alias("fe_p"))
    out = whole.join(inner, o).join(fixed, o, "left")
    return out.withColumns({c: F.round(c, 6) + 0.0 for c, kind in out.dtypes if kind == "double"})


QUERIES = {"primary_effects": primary, "within_effects": lambda s, d: within(s, d).drop("fe_low", "fe_high", "fe_p"), "fixed_effect_table": within}

_ROWS = f"""{models._REGIONS}, mr as (select scope, aspect, scope || '|' || aspect || '|' || i || '|' || j || '|' || k as region, round(avg(rho), 9) as rho, round(avg(mean_abs_margin), 9) as mean_abs_margin, round(avg(min_support), 9) as min_support, round(ln(1 + avg(total_weight)), 9) as log_weight,
  {", ".join(f"round(avg({c}), 9) as {c}" for c in models.OUTCOMES)} from regs group by 1, 2, 3), er as materialized (unpivot mr on {", ".join(models.OUTCOMES)} into name outcome value y)"""
_DUMMIES = [*[f"(scope = '{s}')::int::double" for s in ("expert", "normal")], *[f"(aspect = '{a}')::int::double" for a in sorted(ASPECTS)[1:]]]


def partial_out(name: str, source: str, keys: str, others: list[str]) -> str:
    """CTEs that take the other columns away from y and rho one after the other (with what earlier ones left of them), and the standardised
    coefficient as {name}: (keys, beta)."""
    columns = ["y", "rho", *[f"o{k}" for k in range(len(others))]]
    parts = [f"{name}_0 as (select {keys}, y, rho, stddev_pop(y) over w as sdy, stddev_pop(rho) over w as sdx, {', '.join(f'{e} as o{k}' for k, e in enumerate(others))} from {source} window w as (partition by {keys}))"]
    for k in range(len(others)):
        left = [c for c in columns if c in ("y", "rho") or int(c[1:]) > k]
        share = lambda c, k=k: f"{c} - case when sum(o{k} * o{k}) over w > 1e-9 then sum({c} * o{k}) over w / sum(o{k} * o{k}) over w * o{k} else 0 end as {c}"
        parts.append(f"{name}_{k + 1} as (select {keys}, sdx, sdy, {', '.join(map(share, left))} from {name}_{k} window w as (partition by {keys}))")
    return ", ".join(parts) + f", {name} as (select {keys}, sum(y * rho) / sum(rho * rho) * min(sdx) / min(sdy) as beta from {name}_{len(others)} group by {keys})"


_OTHERS = ["1.0::double", *_DUMMIES, *[f"({c} - avg({c}) over (partition by {{keys}}))" for c in CONTROLS]]
_others = lambda keys: [o.format(keys=keys) for o in _OTHERS]
_U = inference._U
_SP = lambda source, keys: f"select {keys}, corr(rx, ry) as spearman from (select {keys}, rank() over (partition by {keys} order by rho) + (count(*) over (partition by {keys}, rho) - 1) / 2.0::double as rx, rank() over (partition by {keys} order by y) + (count(*) over (partition by {keys}, y) - 1) / 2.0::double as ry from {source}) group by {keys}"
_QE = lambda source, keys: f"select {keys}, avg(y) filter (where rho >= hi) - avg(y) filter (where rho <= lo) as raw, (avg(y) filter (where rho >= hi) - avg(y) filter (where rho <= lo)) / stddev_pop(y) as std from (select *, quantile_cont(rho, 0.25) over (partition by {keys}) as lo, quantile_cont(rho, 0.75) over (partition by {keys}) as hi from {source}) group by {keys}"
_CI = ", ".join(f"quantile_cont({v}, 0.025) as {v}_low, quantile_cont({v}, 0.975) as {v}_high" for v in ("beta", "spearman", "raw", "std"))
_ENDS = ["mean_x", "sd_x", "mean_y", "beta", "spearman", "raw", "std", *[f"{v}_{e}" for v in ("beta", "spearman", "raw", "std") for e in ("low", "high")], "permutation_p", "spearman_p", "permutation_q"]

ORACLE_SQL = {
    "primary_effects": f"""with {_ROWS}, sl as materialized (select *, row_number() over (partition by outcome order by region) - 1 as slot, count(*) over (partition by outcome) as n from er),
dr as materialized (select d.outcome, d.rep, sl.* exclude (outcome) from (select outcome, rep, floor({_U('outcome', 'rep', 'slot')} / 4294967296.0::double * n)::bigint as drawn from sl cross join (select unnest(range({BOOTSTRAPS})) as rep)) d join sl on d.outcome = sl.outcome and d.drawn = sl.slot),
{partial_out("ob", "sl", "outcome", _others("outcome"))}, {partial_out("bb", "dr", "outcome, rep", _others("outcome, rep"))},
bs as ({_SP("dr", "outcome, rep")}), bq as ({_QE("dr", "outcome, rep")}), ci as (select outcome, {_CI} from bb join bs using (outcome, rep) join bq using (outcome, rep) group by 1),
base as (select *, row_number() over (partition by outcome, scope, aspect order by {_U('region')}, region) as p from er), pd as (select outcome, scope, aspect, rep, rho, row_number() over (partition by outcome, scope, aspect, rep order by {_U('rep', 'region')}, region) as p from er cross join (select unnest(range({PERMUTATIONS})) as rep)),
pr as materialized (select base.* exclude (rho), pd.rep, pd.rho from pd join base using (outcome, scope, aspect, p)), {partial_out("pb", "pr", "outcome, rep", _others("outcome, rep"))},
pp as (select ob.outcome, (count(*) filter (where abs(pb.beta) >= abs(ob.beta) - 1e-12) + 1) / (count(*) + 1) as permutation_p from pb join ob on pb.outcome = ob.outcome group by 1),
qq as (select *, row_number() over (order by permutation_p, outcome) as k, count(*) over () as m from pp), q as (select outcome, permutation_p, least(1.0, min(permutation_p * m / k) over (order by k desc rows between unbounded preceding and current row)) as permutation_q from qq),
sz as (select outcome, count(*) as n, avg(rho) as mean_x, stddev_pop(rho) as sd_x, avg(y) as mean_y from er group by 1), os as ({_SP("er", "outcome")}), oq as ({_QE("er", "outcome")}),
al as (select * from sz join ob using (outcome) join os using (outcome) join oq using (outcome) join ci using (outcome) join q using (outcome)), ap as (select *, {inference._P("spearman", "n")} as spearman_p from al)
select outcome, n, {", ".join(f"round({c}, 5) + 0.0 as {c}" for c in _ENDS)} from ap where n >= 30""",
    "within_effects": f"""with {_ROWS}, {partial_out("ob", "er", "outcome", _others("outcome"))}, zc as (select outcome, rho - avg(rho) over w as x, y - avg(y) over w as y, dense_rank() over (partition by outcome order by scope, aspect) as cell from er window w as (partition by outcome, scope, aspect)),
zw as (select outcome, count(*) as n, count(distinct cell) as cells, corr(x, y) as within_r from zc group by 1), zs as ({_SP("er", "outcome")}), za as (select outcome, corr(rho, y) as aggregate_pearson from er group by 1), zl as (select *, n - cells + 1 as nn from zw)
select outcome, round(aggregate_pearson, 6) + 0.0 as aggregate_pearson, round(spearman, 6) + 0.0 as aggregate_spearman, n, round(within_r, 6) + 0.0 as within_r, round({inference._P("within_r", "nn")}, 6) + 0.0 as within_p, round(beta, 6) + 0.0 as fe_beta from zl join zs using (outcome) join za using (outcome) join ob using (outcome)""",
}
