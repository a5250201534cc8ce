"""Scalar against pairwise models: fits, regions, uplift, routing, text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.functions.hashing import hash_int, uniform
from prefgraph.functions.ranking import distributed_rank
from prefgraph.operators import logistic_heads, models, regions, resample, summaries, text_model
from prefgraph.operators.ordering import kept
from prefgraph.plans import comparisons, inference, preferences
from prefgraph.sources.fixtures import table

R6 = lambda *cs: {c: F.round(c, 6) for c in cs}


def flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = preferences.obs(spark, sf_dir)
    splits = resample.prompt_split(preferences.flat(spark, sf_dir), "prompt_id", inference.SPLITS, inference.TEST_SHARE, inference.SEED)
    return regions.split_flows(obs, splits, inference.SPLITS)


def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_table(*flows(spark, sf_dir))


def pairwise_regions(spark, sf_dir):
    out = region_table(spark, sf_dir)
    return out.select(*regions.REGION, "cyclic", "pair_weight", "pair_edges", *[F.round(c, 9).alias(c) for c in ("rho", "mean_abs_margin", *[f"pair_{m}" for m in models.LOSSES])])


def bt_triplets(spark, sf_dir):
    tri = models.bt_triplet(regions.trained_triplets(flows(spark, sf_dir)[0], 5))
    return tri.select(*regions.REGION, *[F.round(c, 6).alias(c) for c in ("score_i", "score_j", "score_k", "gradient_norm")])


def bt_eval(spark, sf_dir):
    return region_table(spark, sf_dir).select(*regions.REGION, *[F.round(f"bt_{m}", 6).alias(f"bt_{m}") for m in models.LOSSES])


def uplift(spark, sf_dir):
    """Per scope and loss: mean uplift, its correlation with the residual, and the quartile effect."""
    rows = region_table(spark, sf_dir)
    long = rows.selectExpr("scope", "rho", f"stack({len(models.LOSSES)}, " + ", ".join(f"'{m}', uplift_{m}" for m in models.LOSSES) + ") as (metric, uplift)")
    keys = ["scope", "metric"]
    mean = long.groupBy(*keys).agg(F.avg("uplift").alias("mean_uplift"))
    return mean.join(summaries.correlation(long, keys, "rho", "uplift"), keys).join(summaries.quartile_effect(long, keys, "rho", "uplift").drop("n"), keys)


def scored_predictions(spark, sf_dir):
    """Metrics of externally scored P(A), here from a hash."""
    rows = preferences.obs(spark, sf_dir).where("aspect = 'overall'").withColumn("a_is_i", F.lit(True)).withColumn("p_a", uniform(7, F.col("prompt_id"), F.col("i"), F.col("j")))
    return models.prediction_metrics(rows, ["annotation_group"])


def text_pairs(spark, sf_dir):
    """A good and a bad document of the same language and source, paired by their order; A and B by hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    per = ["lang", "source", "quality"]
    ranked = distributed_rank(docs, per, hash_int(3, F.col("doc_id")), "doc_id")
    good, bad = ranked.where("quality = 1").drop("quality").withColumnRenamed("doc_id", "good"), ranked.where("quality = 0").drop("quality").withColumnRenamed("doc_id", "bad")
    pairs = good.join(bad, ["lang", "source", "rank"])
    swap = uniform(5, F.col("good"), F.col("bad")) < 0.5
    return pairs.select(F.concat_ws("-", "good", "bad").alias("pair_id"), F.when(swap, F.col("bad")).otherwise(F.col("good")).alias("id_a"), F.when(swap, F.col("good")).otherwise(F.col("bad")).alias("id_b"), (~swap).cast("double").alias("y"), F.lit(1.0).alias("w"))


def tfidf_terms(spark, sf_dir):
    x = text_model.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return x.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("x"), 5).alias("weight"))


def text_reward_fit(spark, sf_dir):
    """Predicted P(A) of the text pairs by a logistic fit on differences of the most frequent words' and word pairs' weights."""
    vectors = kept(text_model.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text"), "text-vectors")
    numbers = kept(text_model.term_numbers(vectors), "text-terms")
    pairs = kept(text_pairs(spark, sf_dir), "text-pairs")
    rows = kept(pairs.select("pair_id", "y", F.col("w").alias("weight")).join(text_model.difference_rows(pairs, vectors, numbers), "pair_id"), "text-rows")
    members = rows.select(F.lit("all").alias("head"), "pair_id")
    head = logistic_heads.fit_heads(rows, members, members.select("head").distinct(), "pair_id", max(numbers.count(), 1))
    return logistic_heads.predict(rows, members, kept(head, "text-head"), "pair_id").join(rows.select("pair_id", "y"), "pair_id").select("pair_id", "y", F.col("p").alias("p_a"))


OUTCOMES = [f"pair_{m}" for m in models.LOSSES]
QUERIES = {
    "region_table": pairwise_regions,
    "bt_triplet": bt_triplets,
    "bt_eval": bt_eval,
    "bt_graph": lambda s, d: models.bt_graph(comparisons.user_edges(s, d), ["score_delta"]).withColumn("theta", F.round("theta", 6)),
    "uplift_summary": uplift,
    "routing_policy": lambda s, d: regions.routing_table(region_table(s, d), ["scope"]),
    "outcome_cube": lambda s, d: regions.outcome_cube(region_table(s, d), OUTCOMES).withColumns(R6("mean", "corr_rho")),
    "region_means": lambda s, d: regions.region_means(region_table(s, d), ["rho", *OUTCOMES]).withColumns({c: F.round(c, 9) for c in ("rho", *OUTCOMES)}),
    "scored_predictions": lambda s, d: scored_predictions(s, d).withColumns(R6(*[f"{k}_{m}" for k in ("straight", "flipped") for m in models.LOSSES])),
    "tfidf_terms": tfidf_terms,
    "text_reward_fit": text_reward_fit,
}

_LOSS = """wi + wj as weight, -wi * ln(q) - wj * ln(1 - q) as log_loss, wi * (1 - q) * (1 - q) + wj * q * q as brier, case when q > 0.5 then wj when q < 0.5 then wi else (wi + wj) / 2 end as error,
  abs(q * (wi + wj) - wi) as pair_calibration, case when wi = wj or q = 0.5 then (wi + wj) / 2 when (wi > wj) = (q > 0.5) then 0 else wi + wj end as majority_error"""
_SPLIT = inference.ORACLE_SQL["prompt_split"]
_SPLIT_CTE = _SPLIT[_SPLIT.index(", p as") + 2 : _SPLIT.index("select prompt_id, split::int")].rstrip() + f", sp as (select prompt_id, split::int as split, k <= greatest(1, round_even(n * {inference.TEST_SHARE}::double, 0)) as is_test from r)"
_REGIONS = f"""{preferences.OBS_SQL}, {_SPLIT_CTE}, so as (select 'all' as scope, * from obs union all select annotation_group, * from obs),
fl as (select scope, split, is_test, aspect, i, j, sum(weight) as support, sum(weight * sign) / sum(weight) as margin, sum(case when sign > 0 then weight else 0 end) as wi, sum(case when sign < 0 then weight else 0 end) as wj from so join sp on so.prompt_id = sp.prompt_id group by 1, 2, 3, 4, 5, 6),
kept as (select split || '|' || scope as scope, aspect, i, j, support, margin from fl where not is_test and support >= 5), {preferences.TRI_SQL},
rg as (select *, (m_ij + m_jk - m_ik) * (m_ij + m_jk - m_ik) / (1 / s_ij + 1 / s_jk + 1 / s_ik) / nullif(s_ij * m_ij * m_ij + s_jk * m_jk * m_jk + s_ik * m_ik * m_ik, 0) as rho from tri),
ed as (select scope, aspect, i, j, k, i as a, j as b, s_ij as s, m_ij as m from rg union all select scope, aspect, i, j, k, j, k, s_jk, m_jk from rg union all select scope, aspect, i, j, k, i, k, s_ik, m_ik from rg),
te as (select ed.*, (0.5 * (s + s * m) + 1) / (s + 2) as q, wi, wj from ed join fl on fl.is_test and fl.split || '|' || fl.scope = ed.scope and fl.aspect = ed.aspect and fl.i = ed.a and fl.j = ed.b),
lo as (select scope, aspect, i, j, k, {_LOSS} from te),
ev as (select scope, aspect, i, j, k, sum(weight) as pair_weight, count(*) as pair_edges, {", ".join(f"sum({m}) / sum(weight) as pair_{m}" for m in models.LOSSES)} from lo group by 1, 2, 3, 4, 5),
regs as (select split_part(rg.scope, '|', 1)::int as split, split_part(rg.scope, '|', 2) as scope, rg.aspect, rg.i, rg.j, rg.k, {preferences.CYC} as cyclic, pair_weight, pair_edges, rho, (abs(m_ij) + abs(m_jk) + abs(m_ik)) / 3 as mean_abs_margin, least(s_ij, s_jk, s_ik) as min_support, s_ij + s_jk + s_ik as total_weight, {", ".join(OUTCOMES)}
  from rg join ev on rg.scope = ev.scope and rg.aspect = ev.aspect and rg.i = ev.i and rg.j = ev.j and rg.k = ev.k where rho is not null and pair_weight >= 5 and pair_edges >= 2)"""
_CUBE = ", ".join(f"avg({m}) as a_{m}, corr(rho, {m}) as c_{m}" for m in OUTCOMES)

ORACLE_SQL = {
    "region_table": f"with {_REGIONS} select split, scope, aspect, i, j, k, cyclic, pair_weight, pair_edges, {', '.join(f'round({c}, 9) as {c}' for c in ('rho', 'mean_abs_margin', *OUTCOMES))} from regs",
    "outcome_cube": f"with {_REGIONS}, lg as ({' union all '.join(f'''select scope, aspect, rho, '{m}' as outcome, {m} as value from regs''' for m in OUTCOMES)}), ex as (select 'every' as scope, 'every' as aspect, rho, outcome, value from lg union all select scope, 'every', rho, outcome, value from lg union all select 'every', aspect, rho, outcome, value from lg union all select scope, aspect, rho, outcome, value from lg) select scope, aspect, outcome, count(value) as n, round(avg(value), 6) as mean, round(corr(rho, value), 6) as corr_rho from (select *, 1 as part from ex) group by 1, 2, 3",
    "region_means": f"with {_REGIONS} select scope, aspect, i, j, k, count(*) as n_rows, count(distinct split) as n_splits, {', '.join(f'round(avg({c}), 9) as {c}' for c in ('rho', *OUTCOMES))} from regs group by 1, 2, 3, 4, 5",
    "scored_predictions": f"""with {preferences.OBS_SQL}, x as (select annotation_group, i, j, sign, weight, cast('0x' || substr(md5(concat_ws('|', '7', prompt_id, i, j)), 1, 8) as bigint) / 4294967296.0::double as p from obs where aspect = 'overall'),
e as (select annotation_group, i, j, sum(case when sign > 0 then weight else 0 end) as wi, sum(case when sign < 0 then weight else 0 end) as wj, sum(weight * p) / sum(weight) as p from x group by 1, 2, 3),
s as (select annotation_group, {_LOSS.replace("q", "p")} from e), f as (select annotation_group, {_LOSS} from (select *, 1 - p as q from e)),
sm as (select annotation_group, sum(weight) as straight_weight, count(*) as straight_edges, {", ".join(f"round(sum({m}) / sum(weight), 6) as straight_{m}" for m in models.LOSSES)} from s group by 1),
fm as (select annotation_group, {", ".join(f"round(sum({m}) / sum(weight), 6) as flipped_{m}" for m in models.LOSSES)} from f group by 1)
select sm.*, {", ".join(f"flipped_{m}" for m in models.LOSSES)} from sm join fm on sm.annotation_group = fm.annotation_group""",
    "tfidf_terms": f"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}') as w from documents), u as (select doc_id, unnest(w) as term from w union all select doc_id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) from w where len(w) > 1),
tf as (select doc_id, term, count(*) as tf from u group by 1, 2), d as (select term, count(*) as df, sum(tf) as total from tf group by 1 having count(*) >= 2 order by 3 desc, 1 limit {text_model.FEATURES}), n as (select count(*) as n from documents),
x as (select doc_id, tf.term, (1 + ln(tf)) * (ln((1 + n)::double / (1 + df)) + 1) as x from tf join d on tf.term = d.term cross join n), nn as (select doc_id, sqrt(sum(x * x)) as l from x group by 1)
select term, count(*) as df, round(sum(x / l), 5) as weight from x join nn on x.doc_id = nn.doc_id group by 1""",
}
