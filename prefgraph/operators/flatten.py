"""Nested comparisons and conversations to flat rows and signed observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefgraph.functions.labels import signed_weight
from prefgraph.sources.fixtures import ASPECTS


def flatten_annotations(rows: DataFrame, groups: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per annotation. ``groups``: array-of-struct column to annotation group; ``keep``: columns of the row kept.

    Rows with all lists null or empty give nothing; the fields of the structs become columns.
    """
    parts = [rows.select(*keep, F.lit(group).alias("annotation_group"), F.explode(column).alias("_a")).select(*keep, "annotation_group", "_a.*") for column, group in groups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_signs(flat: DataFrame, aspects=ASPECTS) -> DataFrame:
    """Adds {aspect}_sign and {aspect}_weight; drops rows that tie in all aspects."""
    named = lambda prefix: ", ".join(f"`{prefix}{a}`" for a in aspects)
    # stacks of one row: what they give are columns, not expressions that a plan repeats for every use of a label or weight
    read = flat.select(*[c for c in flat.columns if c.removesuffix("_pref") not in aspects], F.expr(f"stack(1, {', '.join(f'{a}_pref' for a in aspects)}) as ({named('_l_')})"))
    read = read.select("*", F.stack(F.lit(1), *[F.coalesce(signed_weight(F.col(f"_l_{a}")), F.lit(0.0)) for a in aspects]).alias(*[f"_w_{a}" for a in aspects]))
    read = read.where(" or ".join(f"_w_{a} <> 0" for a in aspects))
    both = [c for a in aspects for c in (F.signum(f"_w_{a}").cast("int").alias(f"{a}_sign"), F.abs(f"_w_{a}").alias(f"{a}_weight"))]
    labels = {f"{a}_pref": F.col(f"_l_{a}").alias(f"{a}_pref") for a in aspects}
    return read.select(*[labels.get(c, F.col(c)) for c in flat.columns], *both)


def observations(flat: DataFrame, keys: list[str], aspects=ASPECTS) -> DataFrame:
    """keys, aspect, i, j, sign, weight with i < j: ties, weights of zero, empty ids and self-pairs are left out."""
    stacked = ", ".join(f"'{a}', {a}_sign, {a}_weight" for a in aspects)
    long = flat.selectExpr(*keys, "cast(alt_a as string) as alt_a", "cast(alt_b as string) as alt_b", f"stack({len(aspects)}, {stacked}) as (aspect, sign, weight)")
    return (
        long.where("sign <> 0 and weight > 0 and alt_a <> alt_b and alt_a <> '' and alt_b <> ''")
        .select(*keys, "aspect", F.least("alt_a", "alt_b").alias("i"), F.greatest("alt_a", "alt_b").alias("j"), F.when(F.col("alt_a") < F.col("alt_b"), F.col("sign")).otherwise(-F.col("sign")).alias("sign"), "weight")
    )


def label_observations(rows: DataFrame, keys: list[str], aspects=ASPECTS) -> DataFrame:
    """The same from the labels {aspect}_pref themselves: each is read once, where its row and aspect are. Rows that tie in all aspects
    give none anyway."""
    stacked = ", ".join(f"'{a}', {a}_pref" for a in aspects)
    long = rows.selectExpr(*keys, "cast(alt_a as string) as alt_a", "cast(alt_b as string) as alt_b", f"stack({len(aspects)}, {stacked}) as (aspect, label)")
    ahead = F.when(F.col("alt_a") < F.col("alt_b"), F.col("w")).otherwise(-F.col("w"))
    signed = long.where("alt_a <> alt_b and alt_a <> '' and alt_b <> ''").withColumn("w", signed_weight(F.col("label"))).where("w <> 0")
    return signed.select(*keys, "aspect", F.least("alt_a", "alt_b").alias("i"), F.greatest("alt_a", "alt_b").alias("j"), F.signum(ahead).cast("int").alias("sign"), F.abs("w").alias("weight"))


def opening_turns(history: DataFrame) -> DataFrame:
    """(conversation_id, pos, model_name, score) from conversation_history: turn 0 of a model, each model's first."""
    turns = history.select("conversation_id", F.posexplode("conversation_history").alias("pos", "t")).where("t.turn = 0 and t.role = 'model' and t.model_name is not null and t.score is not null")
    first = Window.partitionBy("conversation_id", "t.model_name").orderBy("pos")
    return turns.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("conversation_id", "pos", "t.model_name", "t.score")
