"""Labels, shards, samples, catalogues, summaries by scope and resampled intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.functions.hashing import uniform
from prefgraph.functions.labels import A_LABELS, A_SLIGHT, B_LABELS, B_SLIGHT, safe_name, sign_and_weight
from prefgraph.operators import cycles, edges, models, resample
from prefgraph.operators import scopes as ops
from prefgraph.operators import tournament as t
from prefgraph.operators.ordering import kept, numbered
from prefgraph.plans import comparisons, inference, preferences, tournaments
from prefgraph.sources.fixtures import ASPECTS, table
from prefgraph.sources.scans import read_shards, scratch

#: Labels that say nothing and spellings that only the general rule knows, beside the known ones.
OTHER = ("tie", "both", "no-preference", "model-a", "a>b", "better", "Answer A Better", "answer_b_slightly_better")
SPELLINGS = (*A_LABELS, *A_SLIGHT, *B_LABELS, *B_SLIGHT, *OTHER)
REPS, PERMUTATIONS, NULLS, SEED = 200, 500, 500, 1009
LEAST_TRIPLES, TOP = 3, 20


def label_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a label, dealt to the order lines: its sign and weight, and how often it occurs."""
    spelt = F.array(*[F.lit(x) for x in SPELLINGS])
    place = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(SPELLINGS) + 1
    rows = table(spark, sf_dir, "lineitem").select(F.element_at(spelt, place.cast("int")).alias("label"))
    s = sign_and_weight(F.col("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", s["sign"].alias("sign"), s["weight"].alias("weight"), "n")


def shard_union(spark, sf_dir):
    """Customers in three CSV shards with different columns in different orders, joined by name."""
    folder = scratch(spark, "shards")
    rows = table(spark, sf_dir, "customer")
    for k, columns in enumerate((["c_custkey", "c_nationkey"], ["c_acctbal", "c_custkey"], ["c_nationkey", "c_custkey", "c_acctbal"])):
        rows.where(f"c_custkey % 3 = {k}").select(*columns).write.option("header", True).csv(f"{folder}/shard-{k}")
    out = read_shards(spark, f"{folder}/shard-*/*.csv")
    shard = F.regexp_extract("source_file", "shard-([0-9])", 1).cast("int")
    return out.select(shard.alias("shard"), *[F.col(c).cast("long").alias(c) for c in ("c_custkey", "c_nationkey")], F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))


def stable_sample(spark, sf_dir):
    """A tenth of the orders by a hash of their keys, numbered in key order; numbers and rows are the same on every run."""
    rows = table(spark, sf_dir, "orders").where(uniform(SEED, F.col("o_orderkey")) < 0.1).select("o_orderkey", "o_custkey")
    return numbered(rows, "o_orderkey", "raw_idx").select("o_orderkey", "o_custkey", "raw_idx")


def prompt_group_flow(spark, sf_dir):
    """Cycles of each prompt's own flow, of all annotations and of each group's."""
    keys = ["scope", "prompt_id", "aspect"]
    # scopes are dealt within rows, not by grouping sets: annotations are by prompt already and stay where they are
    obs = preferences.obs(spark, sf_dir).withColumn("scope", F.explode(F.array(F.lit("all"), "annotation_group")))
    stats = cycles.small_cycle_stats(edges.edge_flow(obs, keys), keys, 3)
    return stats.select(*keys, "n_edges", "eligible", "cyclic", F.round("cycle_rate", 6).alias("cycle_rate"), F.round("weighted_cycle_intensity", 6).alias("weighted_cycle_intensity"))


def top_cycle_rates(spark, sf_dir):
    """The evaluators with the highest cycle rates among those with enough eligible triples."""
    flow = edges.edge_flow(preferences.obs(spark, sf_dir).where("aspect = 'overall'"), ["evaluator"])
    rates = cycles.margin_cycle_stats(flow, ["evaluator"], 0.0).where(F.col("eligible") >= LEAST_TRIPLES).select("evaluator", "eligible", "cyclic", F.round("cycle_rate", 9).alias("cycle_rate"))
    return ops.top(rates, "cycle_rate", ["eligible", "evaluator"], TOP)


def scope_bundle(spark, sf_dir):
    """Per scope and aspect: nodes, edges, cycles by margin and the projection residual of the same edges with equal weights."""
    flow = kept(preferences.scoped_edges(spark, sf_dir), "scoped-edges")  # a few rows a scope, read by each part
    return ops.bundle(flow, ["scope", "aspect"]).withColumns({c: F.round(c, 6) for c in ("cycle_rate", "rho", "min_abs_margin")})


def cycle_rate_table(spark, sf_dir):
    """Cycle rates with a row per scope and a column per aspect."""
    stats = cycles.margin_cycle_stats(preferences.scoped_edges(spark, sf_dir), ["scope", "aspect"], preferences.MIN_SUPPORT)
    return stats.groupBy("scope").pivot("aspect", list(ASPECTS)).agg(F.round(F.first("cycle_rate"), 6))


def margin_matrix(spark, sf_dir):
    """Overall margins of all annotations as rows of a skew matrix, in the order of the alternatives' names."""
    return ops.matrix(preferences.scoped_edges(spark, sf_dir).where("scope = 'all' and aspect = 'overall'"))


KNOWN = {"PROMO": "Promotion", "ECONOMY": "Economy (low price)"}


def display_names(spark, sf_dir):
    """Part types under the names of reports: known ones by a table, others by their last word."""
    return table(spark, sf_dir, "part").groupBy(ops.display_name(F.col("p_type"), KNOWN).alias("name")).agg(F.count("*").alias("n"))


def triplet_catalogue(spark, sf_dir):
    """All triples of a scope's alternatives, with how many of their edges are there and whether their nodes are all well supported."""
    flow = kept(preferences.scoped_edges(spark, sf_dir), "scoped-edges")  # a few rows a scope, read by each part
    return ops.triplets(flow, ["scope", "aspect"], 50.0)


def bootstrap_summary(spark, sf_dir):
    """Mean, spread and quantiles of each edge's margin over resamples of the users."""
    rows = resample.user_bootstrap(inference.user_table(spark, sf_dir), REPS, SEED)
    quantiles = [F.percentile("margin", q).alias(n) for q, n in ((0.025, "q025"), (0.5, "q500"), (0.975, "q975"))]
    out = rows.groupBy("i", "j").agg(F.count("*").alias("n_reps"), F.avg("margin").alias("mean"), F.stddev("margin").alias("sd"), *quantiles)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("mean", "sd", "q025", "q500", "q975")})


def region_rows(spark, sf_dir) -> DataFrame:
    rows = inference.regions(spark, sf_dir).where("aspect <> 'overall' and rho is not null")
    return rows.select("scope", "aspect", F.concat_ws("|", "aspect", "i", "j", "k").alias("region"), "rho", "size")


def row_bootstrap(spark, sf_dir):
    """Mean residual of each scope's regions, with the percentile interval of resampled rows."""
    return ops.bootstrap_mean(region_rows(spark, sf_dir), "scope", "region", "rho", REPS, SEED).withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


def permutation_p(spark, sf_dir):
    """Slope of size on residual with the share of shuffles within aspects that do as much."""
    rows = ops.permuted_slope(region_rows(spark, sf_dir), ["scope"], ["aspect"], "region", "rho", "size", PERMUTATIONS, SEED)
    return rows.withColumns({c: F.round(c, 6) for c in ("slope", "p")})


def safe_scope_names(spark, sf_dir):
    """Part types as names of files and scopes."""
    return table(spark, sf_dir, "part").groupBy(safe_name(F.concat_ws(": ", "p_brand", "p_type"), 20).alias("name")).agg(F.count("*").alias("n"))


def sign_sanity(spark, sf_dir):
    """Row and pair metrics of scored P(A), as they are and flipped, and how often a row's and its edge's winner differ; A is the
    alternative that comes later by name in every third prompt, where the row's sign is left unturned in every tenth of these."""
    rows = preferences.obs(spark, sf_dir).withColumn("p_a", F.round(uniform(7, F.col("prompt_id"), F.col("i"), F.col("j")), 9))
    rows = rows.withColumn("a_is_i", F.col("prompt_id") % 3 != 0)
    turned = F.when(F.col("a_is_i") | (F.col("prompt_id") % 30 == 0), F.col("sign")).otherwise(-F.col("sign"))
    out = models.row_metrics(rows.withColumn("row_sign", turned), ["annotation_group", "aspect"])
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in out.columns if c.split("_")[-1] not in ("group", "aspect", "obs", "edges")})


def null_means(users: DataFrame, n: int, names: list[str]) -> DataFrame:
    """(metric, observed, null_mean, null_sd, z, p): means over countries of the tournament metrics, against users dealt anew."""
    users = kept(users, "country-users")

    def means(dealt: DataFrame) -> DataFrame:
        both = t.dealt_invariants(users, dealt, n, "country")
        return ops.unpivoted_means(both.withColumn("obstructed", F.col("obstructed").cast("int")), ["rep"], names)

    null = means(resample.permuted_groups(users.select("user_id", "country"), "country", NULLS, SEED))
    observed = means(users.select(F.lit(-1).alias("rep"), "user_id", "country")).select("metric", F.col("value").alias("observed"))
    # a row a metric
    out = ops.against_null(null.join(F.broadcast(observed), "metric"), ["metric"], "value", "observed")
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("observed", "null_mean", "null_sd", "z", "p")})


METRICS = ["cycles", "fraction", "odd_parity", "obstructed"]


def null_comparison(spark, sf_dir):
    """Tournament metrics of countries, observed and with users dealt anew: z and the share of draws that reach as much."""
    return null_means(*tournaments.country_users(spark, sf_dir), METRICS)


def construction_comparison(spark, sf_dir):
    """The same for two constructions side by side: direct choices among brands, and utilities of latent profiles."""
    direct = null_comparison(spark, sf_dir)
    latent = null_means(tournaments.latent_users(spark, sf_dir), len(tournaments.PROFILES), METRICS)
    side = lambda df, name: df.select("metric", *[F.col(c).alias(f"{name}_{c}") for c in ("observed", "null_mean", "z", "p")])
    return side(direct, "direct").join(side(latent, "latent"), "metric").withColumn("z_difference", F.col("direct_z") - F.col("latent_z"))


QUERIES = {f.__name__: f for f in (label_spellings, shard_union, stable_sample, prompt_group_flow, top_cycle_rates, scope_bundle, cycle_rate_table, margin_matrix, display_names, triplet_catalogue, bootstrap_summary, row_bootstrap, permutation_p, safe_scope_names, sign_sanity, null_comparison, construction_comparison)}

_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_U = inference._U
_KEPT = "kept as (select * from edges where support >= {least} and abs(margin) > 0)"
_STATS = f"""s as (select scope, aspect, count(*) as n_edges from kept group by 1, 2), t as (select scope, aspect, count(*) as eligible, count(*) filter (where {preferences.CYC}) as cyclic, sum(case when {preferences.CYC} then abs(m_ij * m_jk * m_ik) else 0 end) as total from tri group by 1, 2),
st as (select s.scope, s.aspect, n_edges, coalesce(eligible, 0) as eligible, coalesce(cyclic, 0) as cyclic, cyclic / eligible as cycle_rate, total / eligible as intensity from s left join t on s.scope = t.scope and s.aspect = t.aspect)"""
_EDGES = "edges as (select scope, aspect, i, j, sum(weight) as support, sum(weight * sign) / sum(weight) as margin from scoped group by 1, 2, 3, 4)"
_REGIONS = f"{inference._REG}, rg as (select scope, aspect, aspect || '|' || triplet as region, rho, size from reg where aspect <> 'overall' and rho is not null and not isnan(rho))"
_NODES = "nodes as (select distinct scope, aspect, n from (select scope, aspect, i as n from edges union all select scope, aspect, j from edges))"
_BY_ASPECT = ", ".join(f"round(max(cycle_rate) filter (where aspect = '{a}'), 6) as {a}" for a in ASPECTS)
_NAMED = " ".join(f"when '{k}' then '{v}'" for k, v in KNOWN.items())

ORACLE_SQL = {
    "label_spellings": f"""with l as (select [{", ".join(f"'{x}'" for x in SPELLINGS)}][(l_orderkey * 7 + l_linenumber) % {len(SPELLINGS)} + 1] as label from lineitem),
v as (select label, case when label in {_LIST(A_LABELS)} or label = 'Answer A Better' then 1.0 when label in {_LIST(A_SLIGHT)} then 0.5 when label in {_LIST(B_LABELS)} then -1.0 when label in {_LIST(B_SLIGHT)} or label = 'answer_b_slightly_better' then -0.5 else 0.0 end as w from l)
select label, sign(w)::int as sign, abs(w)::double as weight, count(*) as n from v group by 1, 2, 3""",
    "shard_union": "select (c_custkey % 3)::int as shard, c_custkey::bigint as c_custkey, case when c_custkey % 3 <> 1 then c_nationkey::bigint end as c_nationkey, case when c_custkey % 3 <> 0 then round(c_acctbal::double, 2) end as c_acctbal from customer",
    "stable_sample": f"select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as raw_idx from orders where {_U('o_orderkey')} / 4294967296.0::double < 0.1",
    "prompt_group_flow": f"""with {preferences.OBS_SQL}, scoped as (select 'all' || '|' || prompt_id as scope, * from obs union all select annotation_group || '|' || prompt_id, * from obs), {_EDGES}, {_KEPT.format(least=0)}, {preferences.TRI_SQL}, {_STATS}
select split_part(scope, '|', 1) as scope, split_part(scope, '|', 2)::bigint as prompt_id, aspect, n_edges, eligible, cyclic, round(cycle_rate, 6) as cycle_rate, round(intensity, 6) as weighted_cycle_intensity from st where n_edges >= 3""",
    "top_cycle_rates": f"""with {preferences.OBS_SQL}, scoped as (select evaluator as scope, * from obs where aspect = 'overall'), {_EDGES}, {_KEPT.format(least=0)}, {preferences.TRI_SQL}, {_STATS}
select scope as evaluator, eligible, cyclic, round(cycle_rate, 9) as cycle_rate from st where eligible >= {LEAST_TRIPLES} order by 4 desc, 2, 1 limit {TOP}""",
    "scope_bundle": f"""with {preferences.SCOPED_SQL}, {_KEPT.format(least=0)}, {preferences.TRI_SQL}, {_STATS}, {_NODES}, k as (select scope, aspect, count(*) as n_nodes from nodes group by 1, 2),
b as (select scope, aspect, i as n, margin as m from edges union all select scope, aspect, j, -margin from edges), r as (select b.scope, b.aspect, n, sum(m) / min(n_nodes) as r from b join k on b.scope = k.scope and b.aspect = k.aspect group by 1, 2, 3),
e as (select e.scope, e.aspect, count(*) as n_all, sum(power(margin - (x.r - y.r), 2)) / sum(margin * margin) as rho, min(abs(margin)) as least from edges e join r x on x.scope = e.scope and x.aspect = e.aspect and x.n = e.i join r y on y.scope = e.scope and y.aspect = e.aspect and y.n = e.j group by 1, 2)
select k.scope, k.aspect, n_nodes, n_all as n_edges, coalesce(eligible, 0) as eligible, coalesce(cyclic, 0) as cyclic, round(cycle_rate, 6) as cycle_rate, case when n_all = n_nodes * (n_nodes - 1) / 2 then round(rho, 6) end as rho, round(least, 6) as min_abs_margin
  from k join e on k.scope = e.scope and k.aspect = e.aspect left join st on k.scope = st.scope and k.aspect = st.aspect""",
    "cycle_rate_table": f"with {preferences.SCOPED_SQL}, {_KEPT.format(least=preferences.MIN_SUPPORT)}, {preferences.TRI_SQL}, {_STATS} select scope, {_BY_ASPECT} from st group by 1",
    "margin_matrix": f"""with {preferences.SCOPED_SQL}, o as (select i, j, margin from edges where scope = 'all' and aspect = 'overall'), n as (select distinct n from (select i as n from o union all select j from o)), b as (select i as x, j as y, margin as m from o union all select j, i, -margin from o)
select p.n as alternative, string_agg(case when p.n = q.n then '0.0' else coalesce(printf('%.6f', round(m, 6) + 0.0), '') end, ',' order by q.n) as margins from n p cross join n q left join b on b.x = p.n and b.y = q.n group by 1""",
    "display_names": f"select coalesce(case p_type {_NAMED} end, upper(substr(regexp_extract(p_type, '([^ ]+)$', 1), 1, 1)) || lower(substr(regexp_extract(p_type, '([^ ]+)$', 1), 2))) as name, count(*) as n from part group by 1",
    "triplet_catalogue": f"""with {preferences.SCOPED_SQL}, w as (select scope, aspect, n, sum(support) >= 50 as fine from (select scope, aspect, i as n, support from edges union all select scope, aspect, j, support from edges) group by 1, 2, 3),
c as (select a.scope, a.aspect, a.n as i, b.n as j, c.n as k, a.fine and b.fine and c.fine as supported from w a join w b on a.scope = b.scope and a.aspect = b.aspect and a.n < b.n join w c on a.scope = c.scope and a.aspect = c.aspect and b.n < c.n)
select c.scope, c.aspect, c.i, c.j, c.k, count(e.i) as n_observed, supported from c left join edges e on e.scope = c.scope and e.aspect = c.aspect and e.i in (c.i, c.j) and e.j in (c.j, c.k) group by 1, 2, 3, 4, 5, 7""",
    "bootstrap_summary": f"""with {comparisons.PAIR_SQL}, um as (select user_id, i, j, avg(pair_sign) as um from pairs where score_delta = 5 and pair_sign <> 0 group by 1, 2, 3), us as (select user_id, row_number() over (order by {_U('user_id')}, user_id) as slot, count(*) over () as n from (select distinct user_id from um)),
d as (select rep, floor({_U('rep', 'slot')} / 4294967296.0::double * n)::bigint + 1 as slot from us cross join (select unnest(range({REPS})) as rep)), c as (select rep, slot, count(*) as times from d group by 1, 2),
f as (select rep, i, j, sum(times * um) / sum(times) as margin from c join us on c.slot = us.slot join um on um.user_id = us.user_id group by 1, 2, 3)
select i, j, count(*) as n_reps, round(avg(margin), 6) + 0.0 as mean, round(stddev(margin), 6) + 0.0 as sd, round(quantile_cont(margin, 0.025), 6) + 0.0 as q025, round(quantile_cont(margin, 0.5), 6) + 0.0 as q500, round(quantile_cont(margin, 0.975), 6) + 0.0 as q975 from f group by 1, 2""",
    "row_bootstrap": f"""with {_REGIONS}, sl as (select scope, region, rho, row_number() over (partition by scope order by {_U('scope', 'region')}, region) as slot, count(*) over (partition by scope) as n from rg),
d as (select scope, rep, floor({_U('scope', 'rep', 'slot')} / 4294967296.0::double * n)::bigint + 1 as slot from sl cross join (select unnest(range({REPS})) as rep)), m as (select d.scope, rep, avg(rho) as m from d join sl on d.scope = sl.scope and d.slot = sl.slot group by 1, 2),
o as (select scope, count(*) as n, avg(rho) as mean from sl group by 1)
select o.scope, min(n) as n, round(min(mean), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from o join m on o.scope = m.scope group by 1""",
    "permutation_p": f"""with {_REGIONS}, base as (select *, row_number() over (partition by scope, aspect order by {_U('region')}, region) as p from rg),
d as (select scope, aspect, rep, rho, row_number() over (partition by scope, aspect, rep order by {_U('rep', 'region')}, region) as p from rg cross join (select unnest(range({PERMUTATIONS})) as rep)),
n as (select d.scope, rep, regr_slope(size, d.rho) as slope from d join base on d.scope = base.scope and d.aspect = base.aspect and d.p = base.p group by 1, 2), o as (select scope, count(*) as n, regr_slope(size, rho) as slope from rg group by 1)
select o.scope, min(o.n) as n, round(min(o.slope), 6) as slope, round((count(*) filter (where abs(n.slope) >= abs(o.slope) - 1e-12) + 1) / (count(*) + 1), 6) as p from o join n on o.scope = n.scope group by 1""",
    "safe_scope_names": "select substr(regexp_replace(p_brand || ': ' || p_type, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 20) as name, count(*) as n from part group by 1",
    "sign_sanity": f"""with {preferences.OBS_SQL}, x0 as (select *, round(cast('0x' || substr(md5(concat_ws('|', '7', prompt_id, i, j)), 1, 8) as bigint) / 4294967296.0::double, 9) as p_a, prompt_id % 3 <> 0 as ai from obs),
x as (select *, case when ai or prompt_id % 30 = 0 then sign else -sign end as rs from x0),
r as (select *, (rs > 0)::int as ta, greatest(1e-12, least(1 - 1e-12, p_a)) as p, (sign > 0)::int as ti from x), q as (select *, case when ai then p else 1 - p end as pi, case when ai then ta else 1 - ta end as tr from r),
rm as (select annotation_group, aspect, sum(weight) as weight, count(*) as n_obs, sum(weight * -(case when ta = 1 then ln(p) else ln(1 - p) end)) / sum(weight) as log_loss, sum(weight * -(case when ta = 1 then ln(1 - p) else ln(p) end)) / sum(weight) as flipped_log_loss,
  sum(weight * (p - ta) * (p - ta)) / sum(weight) as brier, sum(weight * (1 - p - ta) * (1 - p - ta)) / sum(weight) as flipped_brier, sum(weight * ((p >= 0.5) <> (ta = 1))::int) / sum(weight) as error_rate, sum(weight * ((1 - p >= 0.5) <> (ta = 1))::int) / sum(weight) as flipped_error_rate,
  sum(weight * ta) / sum(weight) as mean_target_a, sum(weight * p) / sum(weight) as mean_p_a, sum(weight * (tr <> ti)::int) / sum(weight) as target_mismatch from q group by 1, 2),
pr as (select annotation_group, aspect, i, j, sum(weight) as w, sum(weight * ti) / sum(weight) as o, sum(weight * pi) / sum(weight) as p from q group by 1, 2, 3, 4),
pm as (select annotation_group, aspect, count(*) as edges, sum(w * abs(o - p)) / sum(w) as pair_calibration, sum(w * abs(o - (1 - p))) / sum(w) as flipped_pair_calibration,
  sum(w * case when abs(2 * o - 1) <= 1e-9 or abs(2 * p - 1) <= 1e-9 then 0.5 when (o > 0.5) <> (p > 0.5) then 1 else 0 end) / sum(w) as majority_error, sum(w * case when abs(2 * o - 1) <= 1e-9 or abs(2 * p - 1) <= 1e-9 then 0.5 when (o > 0.5) = (p > 0.5) then 1 else 0 end) / sum(w) as flipped_majority_error,
  sum(w * o) / sum(w) as pair_mean_observed, sum(w * p) / sum(w) as pair_mean_predicted, sum(w * (o > 0.5)::int) / sum(w) as observed_majority_i, sum(w * (p > 0.5)::int) / sum(w) as predicted_majority_i from pr group by 1, 2)
select rm.annotation_group, rm.aspect, n_obs, edges, {", ".join(f"round({e}, 6) + 0.0 as {n}" for n, e in models.ROW_METRICS.items())} from rm join pm on rm.annotation_group = pm.annotation_group and rm.aspect = pm.aspect""",
    "null_comparison": f"""with {tournaments.DENSE_SQL}, m as (select distinct user_id, country from dense where country in (select country from elig)), slots as (select country, row_number() over (order by country, user_id) as position from m),
dealt as (select rep, user_id, row_number() over (partition by rep order by {_U('rep', 'user_id')}, user_id) as position from m cross join (select unnest(range({NULLS})) as rep)),
g as (select rep || '|' || slots.country as country, user_id from dealt join slots on dealt.position = slots.position union all select 'observed|' || country, user_id from m),
w0 as (select g.country, x.a as i, y.a as j, {tournaments._WIN} from g join dense x on g.user_id = x.user_id join dense y on x.user_id = y.user_id and x.a < y.a group by 1, 2, 3), w as (select *, wins_i >= wins_j as beats from w0), {tournaments._T3}, {tournaments._ODD}, {tournaments._CC},
b as (select split_part(cc.country, '|', 1) as rep, avg(cycles) as cycles, avg(fraction) as fraction, avg(odd_parity) as odd_parity, avg((odd_parity > 0)::int) as obstructed from cc join par on cc.country = par.country group by 1),
l as (unpivot b on cycles, fraction, odd_parity, obstructed into name metric value value), o as (select metric, value as observed from l where rep = 'observed'),
s as (select l.metric, min(observed) as observed, avg(value) as null_mean, stddev_pop(value) as null_sd, count(*) filter (where value >= observed - 1e-9) / count(*) as p from l join o on l.metric = o.metric where rep <> 'observed' group by 1)
select metric, round(observed, 6) + 0.0 as observed, round(null_mean, 6) + 0.0 as null_mean, round(null_sd, 6) + 0.0 as null_sd, case when null_sd > 0 then round((observed - null_mean) / null_sd, 6) + 0.0 end as z, round(p, 6) + 0.0 as p from s""",
}
