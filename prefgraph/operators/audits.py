"""Audits of flat annotations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.operators.ordering import kept
from prefgraph.sources.fixtures import ASPECTS


def aspect_disagreement(flat: DataFrame, aspects=ASPECTS) -> DataFrame:
    """Per pair of aspects: annotations with an opinion in both, and how many of them disagree."""
    both = list(combinations(aspects, 2))
    stacked = ", ".join(f"'{a}', '{b}', {a}_sign, {b}_sign" for a, b in both)
    rows = flat.selectExpr(f"stack({len(both)}, {stacked}) as (aspect_1, aspect_2, s1, s2)").where("s1 <> 0 and s2 <> 0")
    return rows.groupBy("aspect_1", "aspect_2").agg(F.count("*").alias("comparable"), F.count_if(F.col("s1") != F.col("s2")).alias("disagree")).withColumn("rate", F.col("disagree") / F.col("comparable"))


def prompt_support(flat: DataFrame) -> DataFrame:
    """Per prompt: rows, models, observed and possible pairs, triangles of observed pairs, and the pairs as JSON.

    One shuffle by prompt. A row holds a prompt's distinct pairs, at most half the square of its models, however many rows it has.
    """
    pair = F.when(F.col("alt_a") != F.col("alt_b"), F.struct(F.least("alt_a", "alt_b").alias("i"), F.greatest("alt_a", "alt_b").alias("j")))
    sets = flat.groupBy("prompt_id").agg(F.count("*").alias("n_rows"), F.collect_set("alt_a").alias("_a"), F.collect_set("alt_b").alias("_b"), F.sort_array(F.collect_set(pair)).alias("_pairs"))
    pairs = F.col("_pairs")
    closing = lambda e: F.filter(pairs, lambda f: (f["i"] == e["j"]) & F.array_contains(pairs, F.struct(e["i"].alias("i"), f["j"].alias("j"))))
    n = F.size(F.array_union("_a", "_b")).cast("long")
    return sets.select(
        "prompt_id", "n_rows", n.alias("n_models"), F.size(pairs).cast("long").alias("n_edges"), (n * (n - 1) / 2).cast("long").alias("possible_edges"),
        F.aggregate(F.transform(pairs, lambda e: F.size(closing(e)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y).alias("n_triangles"),
        F.to_json(F.sort_array(F.transform(pairs, lambda e: F.concat_ws(" | ", e["i"], e["j"])))).alias("edges"),
    )


def support_distribution(support: DataFrame) -> DataFrame:
    """How many prompts have each number of models, pairs and triangles."""
    long = support.selectExpr("stack(3, 'n_models', n_models, 'n_edges', n_edges, 'n_triangles', n_triangles) as (metric, value)")
    return long.groupBy("metric", "value").agg(F.count("*").alias("n_prompts"))


def model_edge_support(flat: DataFrame, aspects=ASPECTS) -> DataFrame:
    rows = flat.where("alt_a <> alt_b").withColumn("i", F.least("alt_a", "alt_b")).withColumn("j", F.greatest("alt_a", "alt_b"))
    return rows.groupBy("i", "j").agg(F.count("*").alias("total"), *[F.count_if(F.col("annotation_group") == g).alias(g) for g in ("normal", "expert")], *[F.count_if(F.col(f"{a}_sign") != 0).alias(f"{a}_non_tie") for a in aspects])


def dataset_audit(flat: DataFrame, aspects=ASPECTS) -> DataFrame:
    """(metric, value): rows, distinct keys, labels and signs of every aspect. Two passes: rows by prompt and evaluator, and rows by their alternatives and labels, which are few
    and are written for the three counts that read them."""
    keys = flat.groupBy("prompt_id", "evaluator").agg(F.count("*").alias("n"))
    sizes = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("prompt_id").alias("prompts"), F.count_distinct("evaluator").alias("evaluators"))
    kinds = kept(flat.groupBy("alt_a", "alt_b", *[f"{a}_{c}" for a in aspects for c in ("pref", "sign")]).agg(F.count("*").alias("n")), "audit-kinds")
    models = kinds.select(F.explode(F.array("alt_a", "alt_b")).alias("m")).agg(F.count_distinct("m").alias("n"))
    counts = sizes.selectExpr("stack(3, 'rows', rows, 'prompts', prompts, 'evaluators', evaluators) as (metric, value)").union(models.selectExpr("'models'", "n"))
    stacked = ", ".join(f"'{a}', {a}_pref, {a}_sign" for a in aspects)
    values = kinds.selectExpr("n", f"stack({len(aspects)}, {stacked}) as (aspect, label, sign)")
    labels = values.groupBy(F.concat_ws(":", F.lit("label"), "aspect", "label").alias("metric")).agg(F.sum("n").alias("value"))
    signs = values.groupBy(F.concat_ws(":", F.lit("sign"), "aspect", F.col("sign").cast("string")).alias("metric")).agg(F.sum("n").alias("value"))
    return counts.union(labels).union(signs)
