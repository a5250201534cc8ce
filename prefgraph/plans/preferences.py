"""Annotations: labels, flattening, audits, edge flows, cycles and triplet residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.functions.labels import response_id, sign_and_weight
from prefgraph.operators import audits, cycles, edges, ordering
from prefgraph.operators.flatten import flatten_annotations, label_observations, with_signs
from prefgraph.sources.fixtures import ANNOTATIONS, ASPECTS, derived, plain

#: Thresholds of the registered queries.
MIN_SUPPORT = 5


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ANNOTATIONS)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_signs(annotations(spark, sf_dir))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_observations(annotations(spark, sf_dir), ["prompt_id", "annotation_group", "evaluator"])


# Oracle text: plain case analysis over the same annotations.
_SIGN = lambda c: f"case when {c} like 'A%' then 1 when {c} like 'B%' then -1 else 0 end"
_WEIGHT = lambda c: f"case when {c} = 'Tie' then 0.0 when {c} like '%slightly%' then 0.5 else 1.0 end::double"
ANN_SQL = f"ann as ({plain(ANNOTATIONS)})"
FLAT_SQL = (
    ANN_SQL
    + ", flat as (select *, "
    + ", ".join(f"{_SIGN(a + '_pref')} as {a}_sign, {_WEIGHT(a + '_pref')} as {a}_weight" for a in ASPECTS)
    + " from ann where not ("
    + " and ".join(f"{a}_pref = 'Tie'" for a in ASPECTS)
    + "))"
)
OBS_SQL = (
    FLAT_SQL
    + ", long as ("
    + " union all ".join(f"select prompt_id, annotation_group, evaluator, alt_a, alt_b, '{a}' as aspect, {a}_sign as s, {a}_weight as weight from flat" for a in ASPECTS)
    + "), obs as (select prompt_id, annotation_group, evaluator, aspect, case when alt_a < alt_b then alt_a else alt_b end as i, case when alt_a < alt_b then alt_b else alt_a end as j,"
    + " case when alt_a < alt_b then s else -s end as sign, weight from long where s <> 0 and alt_a <> alt_b)"
)
SCOPED_SQL = (
    OBS_SQL
    + ", scoped as (select 'all' as scope, * from obs union all select annotation_group as scope, * from obs),"
    + " edges as (select scope, aspect, i, j, sum(weight) as support, sum(weight * sign) as weighted_margin, sum(case when sign > 0 then weight else 0.0 end) as i_wins,"
    + " sum(case when sign < 0 then weight else 0.0 end) as j_wins, count(*) as n_obs, sum(weight * sign) / sum(weight) as margin from scoped group by scope, aspect, i, j)"
)
TRI_SQL = (
    "tri as (select x.scope, x.aspect, x.i, x.j, y.j as k, x.margin as m_ij, y.margin as m_jk, z.margin as m_ik, x.support as s_ij, y.support as s_jk, z.support as s_ik"
    " from kept x join kept y on x.scope = y.scope and x.aspect = y.aspect and x.j = y.i join kept z on x.scope = z.scope and x.aspect = z.aspect and x.i = z.i and y.j = z.j)"
)
CYC = "((m_ij > 0 and m_jk > 0 and m_ik < 0) or (m_ij < 0 and m_jk < 0 and m_ik > 0))"


def scoped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.scoped_edge_flow(obs(spark, sf_dir), ["aspect"], "annotation_group")


def label_sign_weight(spark, sf_dir):
    rows = annotations(spark, sf_dir).selectExpr("stack(4, " + ", ".join(f"'{a}', {a}_pref" for a in ASPECTS) + ") as (aspect, label)")
    s = sign_and_weight(F.col("label"))
    return rows.select("aspect", "label", s["sign"].alias("sign"), s["weight"].alias("weight")).groupBy("aspect", "label", "sign", "weight").agg(F.count("*").alias("n"))


def flattened(spark, sf_dir):
    """The annotations nested into lists per comparison and group, and flattened again."""
    fields = ["evaluator", *[f"{a}_pref" for a in ASPECTS]]
    rows = annotations(spark, sf_dir)
    key = ["prompt_id", "pos_a", "pos_b", "alt_a", "alt_b"]
    only = lambda g: F.collect_list(F.when(F.col("annotation_group") == g, F.struct(*fields)))
    nested = rows.groupBy(*key).agg(only("normal").alias("normal_worker_annotations"), only("expert").alias("expert_worker_annotations"))
    return with_signs(flatten_annotations(nested, {"normal_worker_annotations": "normal", "expert_worker_annotations": "expert"}, key))


def response_alt_ids(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    return rows.select("prompt_id", "pos_a", "pos_b", response_id(F.col("prompt_id"), "A", F.col("alt_a")).alias("id_a"), response_id(F.col("prompt_id"), "B", F.col("alt_b")).alias("id_b"))


def prompt_local_flow(spark, sf_dir):
    """Per prompt and aspect: nodes, edges and cycles of the prompt's own flow, where it has three edges or more."""
    keys = ["prompt_id", "aspect"]
    flow = edges.edge_flow(obs(spark, sf_dir), keys)
    nodes = flow.select(*keys, F.explode(F.array("i", "j")).alias("n")).groupBy(*keys).agg(F.count_distinct("n").alias("n_nodes"))
    stats = cycles.margin_cycle_stats(flow, keys, 0.0).where("n_edges >= 3")
    return stats.join(nodes, keys).where("n_nodes >= 3").select(*keys, "n_nodes", "n_edges", "eligible", "cyclic", F.round("cycle_rate", 6).alias("cycle_rate"), F.round("weighted_cycle_intensity", 6).alias("weighted_cycle_intensity"))


def prompt_local_summary(spark, sf_dir):
    rows = ordering.kept(prompt_local_flow(spark, sf_dir), "prompt-local")  # read again by each pass for the median
    sums = rows.groupBy("aspect").agg(F.count("*").alias("prompts"), F.sum("eligible").alias("eligible"), F.sum("cyclic").alias("cyclic"), F.round(F.avg("cycle_rate"), 6).alias("mean_rate"), F.round(F.try_divide(F.sum("cyclic"), F.sum("eligible")), 6).alias("pooled_rate"))
    median = ordering.quantiles(rows, ["aspect"], "cycle_rate", {"median_rate": 0.5})
    return sums.join(median, "aspect", "left").withColumn("median_rate", F.round("median_rate", 6))


def edge_flow_by_group(spark, sf_dir):
    return scoped_edges(spark, sf_dir).select("scope", "aspect", "i", "j", "support", "weighted_margin", "i_wins", "j_wins", "n_obs", F.round("margin", 6).alias("margin"))


def margin_cycles(spark, sf_dir):
    stats = cycles.margin_cycle_stats(scoped_edges(spark, sf_dir), ["scope", "aspect"], MIN_SUPPORT)
    return stats.select("scope", "aspect", "n_edges", "eligible", "cyclic", F.round("cycle_rate", 6).alias("cycle_rate"), F.round("weighted_cycle_intensity", 9).alias("weighted_cycle_intensity"))


def triplet_rho(spark, sf_dir):
    rows = cycles.triplet_residual(scoped_edges(spark, sf_dir), ["scope", "aspect"], MIN_SUPPORT)
    return rows.select("scope", "aspect", "i", "j", "k", "cyclic", F.round("residual_energy", 6).alias("residual_energy"), F.round("total_energy", 6).alias("total_energy"), F.round("rho", 6).alias("rho"))


def evaluator_flow(spark, sf_dir):
    """Edge flow of the evaluators with the most annotations."""
    rows = obs(spark, sf_dir).where("aspect = 'overall'")
    top = rows.groupBy("evaluator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "evaluator").limit(20)
    flow = edges.edge_flow(rows.join(F.broadcast(top.select("evaluator")), "evaluator"), ["evaluator"])
    return flow.select("evaluator", "i", "j", "support", "weighted_margin", "n_obs", F.round("margin", 6).alias("margin"))


def weight_cells(spark, sf_dir):
    return edges.weight_cells(obs(spark, sf_dir), ["aspect"])


QUERIES = {
    "label_sign_weight": label_sign_weight,
    "flatten_annotations": flattened,
    "response_alt_ids": response_alt_ids,
    "edge_flow_by_group": edge_flow_by_group,
    "evaluator_flow": evaluator_flow,
    "weight_cells": weight_cells,
    "prompt_local_flow": prompt_local_flow,
    "prompt_local_summary": prompt_local_summary,
    "margin_cycle_stats": margin_cycles,
    "triplet_rho": triplet_rho,
    "aspect_disagreement": lambda spark, sf_dir: audits.aspect_disagreement(flat(spark, sf_dir)).withColumn("rate", F.round("rate", 6)),
    "prompt_support_audit": lambda spark, sf_dir: audits.prompt_support(flat(spark, sf_dir)),
    "support_distribution": lambda spark, sf_dir: audits.support_distribution(audits.prompt_support(flat(spark, sf_dir))),
    "model_edge_support": lambda spark, sf_dir: audits.model_edge_support(flat(spark, sf_dir)),
    "dataset_audit": lambda spark, sf_dir: audits.dataset_audit(flat(spark, sf_dir)),
}

_LOCAL_SQL = f"""{OBS_SQL}, kept0 as (select prompt_id as scope, aspect, i, j, sum(weight * sign) / sum(weight) as margin, sum(weight) as support from obs group by 1, 2, 3, 4),
kept as (select * from kept0 where abs(margin) > 0), {TRI_SQL},
nodes as (select scope, aspect, count(distinct n) as n_nodes from (select scope, aspect, i as n from kept0 union all select scope, aspect, j from kept0) group by 1, 2),
sizes as (select scope, aspect, count(*) as n_edges from kept group by 1, 2 having count(*) >= 3),
t as (select scope, aspect, count(*) as eligible, count(*) filter (where {CYC}) as cyclic, sum(case when {CYC} then abs(m_ij * m_jk * m_ik) else 0 end) as total from tri group by 1, 2),
local as (select s.scope as prompt_id, s.aspect, n_nodes, n_edges, coalesce(eligible, 0) as eligible, coalesce(cyclic, 0) as cyclic, round(cyclic / eligible, 6) as cycle_rate, round(total / eligible, 6) as weighted_cycle_intensity
  from sizes s join nodes n on s.scope = n.scope and s.aspect = n.aspect left join t on s.scope = t.scope and s.aspect = t.aspect where n_nodes >= 3)"""
_SUPPORT_SQL = f"""{FLAT_SQL}, m as (select prompt_id, alt_a as m from flat union select prompt_id, alt_b from flat),
e as (select distinct prompt_id, least(alt_a, alt_b) as i, greatest(alt_a, alt_b) as j from flat where alt_a <> alt_b),
sup as (select r.prompt_id, n_rows, n_models, coalesce(n_edges, 0) as n_edges, (n_models * (n_models - 1) / 2)::bigint as possible_edges, coalesce(n_triangles, 0) as n_triangles, coalesce(edges, '[]') as edges
  from (select prompt_id, count(*) as n_rows from flat group by 1) r join (select prompt_id, count(*) as n_models from m group by 1) k on r.prompt_id = k.prompt_id
  left join (select prompt_id, count(*) as n_edges, '[' || string_agg('"' || i || ' | ' || j || '"', ',' order by i || ' | ' || j) || ']' as edges from e group by 1) x on r.prompt_id = x.prompt_id
  left join (select a.prompt_id, count(*) as n_triangles from e a join e b on a.prompt_id = b.prompt_id and a.j = b.i join e c on a.prompt_id = c.prompt_id and a.i = c.i and b.j = c.j group by 1) t on r.prompt_id = t.prompt_id)"""
_PAIRS = [(a, b) for n, a in enumerate(ASPECTS) for b in ASPECTS[n + 1 :]]

ORACLE_SQL = {
    "label_sign_weight": f"with {ANN_SQL}, l as ({' union all '.join(f'''select '{a}' as aspect, {a}_pref as label from ann''' for a in ASPECTS)}) select aspect, label, ({_SIGN('label')})::int as sign, {_WEIGHT('label')} as weight, count(*) as n from l group by 1, 2, 3, 4",
    "flatten_annotations": f"with {FLAT_SQL} select prompt_id, pos_a, pos_b, alt_a, alt_b, annotation_group, evaluator, {', '.join(f'{a}_pref, ({a}_sign)::int as {a}_sign, {a}_weight' for a in ASPECTS)} from flat",
    "response_alt_ids": f"with {ANN_SQL} select prompt_id, pos_a, pos_b, prompt_id || '::A_' || substr(sha1(alt_a), 1, 12) as id_a, prompt_id || '::B_' || substr(sha1(alt_b), 1, 12) as id_b from ann",
    "edge_flow_by_group": f"with {SCOPED_SQL} select scope, aspect, i, j, support, weighted_margin, i_wins, j_wins, n_obs, round(margin, 6) as margin from edges",
    "evaluator_flow": f"with {OBS_SQL}, top as (select evaluator from obs where aspect = 'overall' group by 1 order by count(*) desc, evaluator limit 20) select evaluator, i, j, sum(weight) as support, sum(weight * sign) as weighted_margin, count(*) as n_obs, round(sum(weight * sign) / sum(weight), 6) as margin from obs where aspect = 'overall' and evaluator in (select evaluator from top) group by 1, 2, 3",
    "weight_cells": f"with {OBS_SQL} select aspect, i, j, weight, count(*) as n from obs group by 1, 2, 3, 4",
    "prompt_local_flow": f"with {_LOCAL_SQL} select * from local",
    "prompt_local_summary": f"with {_LOCAL_SQL} select aspect, count(*) as prompts, sum(eligible)::bigint as eligible, sum(cyclic)::bigint as cyclic, round(avg(cycle_rate), 6) as mean_rate, round(quantile_cont(cycle_rate, 0.5), 6) as median_rate, round(sum(cyclic)::double / nullif(sum(eligible), 0), 6) as pooled_rate from local group by 1",
    "margin_cycle_stats": f"""with {SCOPED_SQL}, kept as (select * from edges where support >= {MIN_SUPPORT} and abs(margin) > 0), {TRI_SQL},
s as (select scope, aspect, count(*) as n_edges from kept group by 1, 2), t as (select scope, aspect, count(*) as eligible, count(*) filter (where {CYC}) as cyclic, sum(case when {CYC} then abs(m_ij * m_jk * m_ik) else 0 end) as total from tri group by 1, 2)
select s.scope, s.aspect, n_edges, coalesce(eligible, 0) as eligible, coalesce(cyclic, 0) as cyclic, round(cyclic / eligible, 6) as cycle_rate, round(total / eligible, 9) as weighted_cycle_intensity from s left join t on s.scope = t.scope and s.aspect = t.aspect""",
    "triplet_rho": f"""with {SCOPED_SQL}, kept as (select * from edges where support >= {MIN_SUPPORT}), {TRI_SQL},
e as (select *, (m_ij + m_jk - m_ik) * (m_ij + m_jk - m_ik) / (1 / s_ij + 1 / s_jk + 1 / s_ik) as r, s_ij * m_ij * m_ij + s_jk * m_jk * m_jk + s_ik * m_ik * m_ik as t from tri)
select scope, aspect, i, j, k, {CYC} as cyclic, round(r, 6) as residual_energy, round(t, 6) as total_energy, case when t > 0 then round(r / t, 6) end as rho from e""",
    "aspect_disagreement": f"with {FLAT_SQL} "
    + " union all ".join(f"select '{a}' as aspect_1, '{b}' as aspect_2, count(*) as comparable, count(*) filter (where {a}_sign <> {b}_sign) as disagree, round(count(*) filter (where {a}_sign <> {b}_sign) / count(*), 6) as rate from flat where {a}_sign <> 0 and {b}_sign <> 0" for a, b in _PAIRS),
    "prompt_support_audit": f"with {_SUPPORT_SQL} select * from sup",
    "support_distribution": f"with {_SUPPORT_SQL} " + " union all ".join(f"select '{c}' as metric, {c} as value, count(*) as n_prompts from sup group by {c}" for c in ("n_models", "n_edges", "n_triangles")),
    "model_edge_support": f"with {FLAT_SQL} select least(alt_a, alt_b) as i, greatest(alt_a, alt_b) as j, count(*) as total, count(*) filter (where annotation_group = 'normal') as normal, count(*) filter (where annotation_group = 'expert') as expert, {', '.join(f'count(*) filter (where {a}_sign <> 0) as {a}_non_tie' for a in ASPECTS)} from flat where alt_a <> alt_b group by 1, 2",
    "dataset_audit": f"with {FLAT_SQL}, v as ({' union all '.join(f'''select '{a}' as aspect, {a}_pref as label, {a}_sign as sign from flat''' for a in ASPECTS)}) select 'rows' as metric, count(*) as value from flat union all select 'prompts', count(distinct prompt_id) from flat union all select 'evaluators', count(distinct evaluator) from flat union all select 'models', count(*) from (select alt_a from flat union select alt_b from flat) union all select 'label:' || aspect || ':' || label, count(*) from v group by aspect, label union all select 'sign:' || aspect || ':' || sign, count(*) from v group by aspect, sign",
}
