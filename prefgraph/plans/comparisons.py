"""Scored conversations: opening pairs, user flows, threshold grids, strongest cycles, JSON cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.functions.literals import with_json
from prefgraph.operators import cycles, edges
from prefgraph.operators.flatten import opening_turns
from prefgraph.operators.pairs import DELTAS, opening_pairs
from prefgraph.sources.fixtures import OPENINGS, derived, plain, table

N_MINS, TAUS = (1, 10, 25), (0.0, 0.1)


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, OPENINGS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opening_pairs(openings(spark, sf_dir))


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.user_edge_flow(pairs(spark, sf_dir), ["score_delta"])


HISTORY = "array<struct<turn: int, role: string, model_name: string, model_provider: string, score: double, within_turn_id: int, if_chosen: boolean>>"


def opening_history(spark, sf_dir):
    """Openings as JSON history, parsed, and their audit: rows by status."""
    rows = openings(spark, sf_dir)
    entry = F.struct("pos", F.lit(0).alias("turn"), F.lit("model").alias("role"), "model_name", F.col("score").cast("double").alias("score"))
    text = F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("pos")))
    # every third cell is spelt as a Python literal, every 50th is spoilt, every 50th empty
    spelt = F.when(F.col("conversation_id") % 3 == 1, F.replace("_text", F.lit('"'), F.lit("'"))).otherwise(F.col("_text"))
    cell = F.when(F.col("conversation_id") % 50 == 1, F.lit("not json")).when(F.col("conversation_id") % 50 == 2, F.lit(None)).otherwise(spelt)
    history = rows.groupBy("conversation_id").agg(text.alias("_text")).select("conversation_id", cell.alias("cell"))
    parsed = with_json(history, "cell", "_json").withColumn("conversation_history", F.from_json("_json", HISTORY, {"mode": "PERMISSIVE"})).drop("_json")
    found = opening_turns(parsed).groupBy("conversation_id").agg(F.count("*").alias("models"), F.sum("score").alias("score"))
    status = F.when(F.col("cell").isNull(), "no_history").when(F.col("conversation_history").isNull() | F.col("models").isNull(), "bad_history").when(F.col("models") < 2, "too_few_models").otherwise("ok")
    return parsed.join(found, "conversation_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("conversations"), F.coalesce(F.sum("models"), F.lit(0)).alias("models"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))


def json_props_parse(spark, sf_dir):
    """Event properties as numbers; what isn't JSON or has no number counts as bad."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k double")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("parsed"), F.sum(F.col("k").cast("long")).alias("k_sum"))


def grid(spark, sf_dir):
    out = cycles.support_cycle_grid(user_edges(spark, sf_dir), ["score_delta"], N_MINS, TAUS)
    return out.select("score_delta", "n_min", "tau", "eligible_triples", "cyclic_triples", F.round("cycle_rate", 6).alias("cycle_rate"), F.round("intensity_sum", 6).alias("intensity_sum"), F.round("intensity_mean", 6).alias("intensity_mean"))


def strongest(spark, sf_dir):
    out = cycles.strongest_cycles(user_edges(spark, sf_dir), ["score_delta"], 1, 20)
    return out.select("score_delta", "cycle_rank", "model_1", "model_2", "model_3", F.round("intensity", 6).alias("intensity"), F.round("min_abs_margin", 6).alias("min_abs_margin"))


QUERIES = {
    "opening_history": opening_history,
    "json_props_parse": json_props_parse,
    "opening_pairs": lambda s, d: pairs(s, d).select("conversation_id", "user_id", "score_delta", "i", "j", "pair_sign", "is_winner_edge", "gap"),
    "user_edge_flow": lambda s, d: user_edges(s, d).withColumn("margin", F.round("margin", 6)),
    "conversation_edge_flow": lambda s, d: edges.conversation_edge_flow(pairs(s, d), ["score_delta"]).withColumn("margin", F.round("margin", 6)),
    "threshold_grid_cycles": grid,
    "strongest_cycles": strongest,
    "skew_lookup": lambda s, d: edges.skew(edges.conversation_edge_flow(pairs(s, d), ["score_delta"]), ["score_delta"]).withColumn("margin", F.round("margin", 6) + 0.0),
}

OPEN_SQL = f"openings as ({plain(OPENINGS)})"
PAIR_SQL = f"""{OPEN_SQL}, deltas as (select unnest([{", ".join(f"{d}::double" for d in DELTAS)}]) as score_delta),
top as (select conversation_id, max(score) as top_score from openings group by 1),
single as (select o.conversation_id, min(model_name) as best from openings o join top t on o.conversation_id = t.conversation_id and score = top_score group by 1 having count(*) = 1),
p0 as (select a.conversation_id, a.user_id, score_delta, a.model_name as mi, b.model_name as mj, case when a.score - b.score > score_delta then 1 when a.score - b.score < -score_delta then -1 else 0 end as sign, abs(a.score - b.score) as gap
  from openings a join openings b on a.conversation_id = b.conversation_id and a.pos < b.pos cross join deltas),
pairs as (select p0.conversation_id, user_id, score_delta, least(mi, mj) as i, greatest(mi, mj) as j, case when mi <= mj then sign else -sign end as pair_sign,
  coalesce(best = case when sign = 1 then mi when sign = -1 then mj end, false) as is_winner_edge, gap from p0 left join single on p0.conversation_id = single.conversation_id)"""
UE_SQL = f"""{PAIR_SQL}, um as (select score_delta, user_id, i, j, avg(pair_sign) as m, count(*) as n from pairs where pair_sign <> 0 group by 1, 2, 3, 4),
ue as (select score_delta, i, j, avg(m) as margin, count(distinct user_id) as support, sum(n)::bigint as total_observations from um group by 1, 2, 3)"""
TRI_UE = """t as (select x.score_delta, x.i, x.j, y.j as k, x.margin as a, y.margin as b, -z.margin as c, least(x.support, y.support, z.support) as s, abs(x.margin * y.margin * z.margin) as w
  from ue x join ue y on x.score_delta = y.score_delta and x.j = y.i join ue z on x.score_delta = z.score_delta and x.i = z.i and y.j = z.j)"""
_C = "((a > tau and b > tau and c > tau) or (a < -tau and b < -tau and c < -tau))"

ORACLE_SQL = {
    "opening_history": f"""with {OPEN_SQL}, c as (select conversation_id, count(*) as models, sum(score) as score from openings group by 1)
select case when conversation_id % 50 = 2 then 'no_history' when conversation_id % 50 = 1 then 'bad_history' when models < 2 then 'too_few_models' else 'ok' end as status, count(*) as conversations,
  sum(case when conversation_id % 50 in (1, 2) then 0 else models end)::bigint as models, sum(case when conversation_id % 50 in (1, 2) then 0 else score end) as score from c group by 1""",
    "json_props_parse": "select event_type, count(*) as n, count(try_cast(json_extract_string(props, '$.k') as double)) as parsed, sum(try_cast(json_extract_string(props, '$.k') as double)::bigint)::bigint as k_sum from events group by 1",
    "opening_pairs": f"with {PAIR_SQL} select conversation_id, user_id, score_delta, i, j, pair_sign::int as pair_sign, is_winner_edge, gap from pairs",
    "user_edge_flow": f"with {UE_SQL} select score_delta, i, j, round(margin, 6) as margin, support, total_observations from ue",
    "conversation_edge_flow": f"with {PAIR_SQL} select score_delta, i, j, round(avg(pair_sign), 6) as margin, count(*) as support from pairs where pair_sign <> 0 group by 1, 2, 3",
    "threshold_grid_cycles": f"""with {UE_SQL}, {TRI_UE}, g as (select unnest([{", ".join(map(str, N_MINS))}])::bigint as n_min), h as (select unnest([{", ".join(f"{t}::double" for t in TAUS)}]) as tau)
select score_delta, n_min, tau, count(*) as eligible_triples, count(*) filter (where {_C}) as cyclic_triples, round(count(*) filter (where {_C}) / count(*), 6) as cycle_rate, round(sum(case when {_C} then w else 0 end), 6) as intensity_sum,
  round(coalesce(avg(w) filter (where {_C}), 0), 6) as intensity_mean from t, g, h where s >= n_min group by 1, 2, 3""",
    "strongest_cycles": f"""with {UE_SQL}, {TRI_UE}, r as (select *, row_number() over (partition by score_delta order by round(w, 9) desc, i, j, k) as cycle_rank from t where {_C.replace("tau", "0")})
select score_delta, cycle_rank::int as cycle_rank, case when a > 0 then i else k end as model_1, j as model_2, case when a > 0 then k else i end as model_3, round(w, 6) as intensity, round(least(abs(a), abs(b), abs(c)), 6) as min_abs_margin from r where cycle_rank <= 20""",
    "skew_lookup": f"with {PAIR_SQL}, e as (select score_delta, i, j, round(avg(pair_sign), 6) as margin, count(*) as support from pairs where pair_sign <> 0 group by 1, 2, 3) select score_delta, i as a, j as b, margin + 0.0 as margin, support from e union all select score_delta, j, i, -margin + 0.0, support from e",
}
