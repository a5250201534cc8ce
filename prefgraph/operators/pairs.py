"""Comparisons between the openings of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefgraph.functions.labels import score_sign

DELTAS = (0.0, 2.0, 5.0, 10.0)


def opening_pairs(openings: DataFrame, deltas=DELTAS, carry: list[str] = ("user_id",)) -> DataFrame:
    """All pairs of a conversation's openings at every score threshold, with the canonical pair (i <= j), its sign, and
    whether the pair's winner is the conversation's only best (with the gap to the loser). One equi-join, no nested loop."""
    per = Window.partitionBy("conversation_id")
    best = openings.withColumn("_top", F.max("score").over(per))
    best = best.withColumn("_n_top", F.sum((F.col("score") == F.col("_top")).cast("long")).over(per)).withColumn("_only", (F.col("_n_top") == 1) & (F.col("score") == F.col("_top")))
    a, b = best.alias("a"), best.alias("b")
    pairs = a.join(b, F.col("a.conversation_id") == F.col("b.conversation_id")).where("a.pos < b.pos")
    pairs = pairs.select(
        F.col("a.conversation_id").alias("conversation_id"), *[F.col(f"a.{c}").alias(c) for c in carry], F.col("a.model_name").alias("model_i"), F.col("b.model_name").alias("model_j"),
        F.col("a.score").alias("score_i"), F.col("b.score").alias("score_j"), F.col("a._only").alias("_a"), F.col("b._only").alias("_b"), F.explode(F.array(*map(F.lit, deltas))).alias("score_delta"),
    )
    sign = score_sign(F.col("score_i"), F.col("score_j"), F.col("score_delta"))
    pairs = pairs.withColumn("sign", sign)
    return pairs.select(
        "conversation_id", *carry, "score_delta", "model_i", "model_j", "sign",
        F.least("model_i", "model_j").alias("i"), F.greatest("model_i", "model_j").alias("j"),
        F.when(F.col("model_i") <= F.col("model_j"), F.col("sign")).otherwise(-F.col("sign")).alias("pair_sign"),
        (((F.col("sign") == 1) & F.col("_a")) | ((F.col("sign") == -1) & F.col("_b"))).alias("is_winner_edge"),
        F.abs(F.col("score_i") - F.col("score_j")).alias("gap"),
    )
