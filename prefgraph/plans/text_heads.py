"""Text reward models by split: pooled heads against one head a group, on regions of models that the fits haven't seen the test prompts of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.functions.hashing import hash_int
from prefgraph.functions.ranking import distributed_rank
from prefgraph.operators import logistic_heads, regions, resample, text_model
from prefgraph.operators.edges import scoped_edge_flow
from prefgraph.operators.ordering import kept
from prefgraph.plans import inference
from prefgraph.sources.fixtures import table

MODELS, PER_BAD = 5, 8


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, prompt_id, aspect, annotation_group, i, j, id_i, id_j, sign, weight: each document with the worse label of an aspect is a prompt, compared with up to
    ``PER_BAD`` better ones of its language by order of hashes; a document's model is its source's number modulo ``MODELS``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'clean', 1 - toxic) as (aspect, good)")).where("good is not null")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and lang is not null").dropDuplicates(["doc_id"])
    model = F.concat(F.lit("m"), F.coalesce(F.try_to_number(F.regexp_extract("source", "([0-9]+)", 1), F.lit("999999999")).cast("long"), F.lit(0)) % MODELS)
    rows = docs.select("doc_id", F.col("lang").alias("annotation_group"), model.alias("model")).join(labels, "doc_id")
    per = ["annotation_group", "aspect", "good"]
    ranked = distributed_rank(rows, per, hash_int(3, F.col("doc_id")), "doc_id")
    good, bad = ranked.where("good = 1"), ranked.where("good = 0")
    sizes = ranked.groupBy("annotation_group", "aspect").agg(F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad"))
    asked = bad.join(sizes.where("n_good > 0"), ["annotation_group", "aspect"]).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(PER_BAD - 1)))).where("_s < n_good")
    place = (F.col("rank") - 1 + F.col("_s") * F.col("n_bad")) % F.col("n_good") + 1
    asked = asked.select("annotation_group", "aspect", F.col("doc_id").alias("bad"), F.col("model").alias("bad_model"), place.alias("rank")).distinct()
    pairs = asked.join(good.select("annotation_group", "aspect", "rank", F.col("doc_id").alias("good_id"), F.col("model").alias("good_model")), ["annotation_group", "aspect", "rank"]).where("good_model <> bad_model")
    first = F.col("good_model") < F.col("bad_model")
    side = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return pairs.select(F.concat_ws("-", "aspect", "good_id", "bad").alias("pair_id"), F.concat_ws("-", "aspect", "bad").alias("prompt_id"), "aspect", "annotation_group", side("good_model", "bad_model").alias("i"), side("bad_model", "good_model").alias("j"), side("good_id", "bad").alias("id_a"), side("bad", "good_id").alias("id_b"), F.when(first, 1).otherwise(-1).alias("sign"), F.lit(1.0).alias("weight"))


def features(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> tuple[DataFrame, int]:
    """Rows of sparse differences: pair_id, y, weight, index, value; and how many terms there are."""
    wanted = pairs.select(F.explode(F.array("id_a", "id_b")).alias("doc_id")).distinct()
    vectors = kept(text_model.tfidf(table(spark, sf_dir, "documents").dropDuplicates(["doc_id"]).join(wanted, "doc_id", "left_semi"), "doc_id", "text"), "text-vectors")
    terms = kept(text_model.term_numbers(vectors), "text-terms")
    rows = pairs.select("pair_id", ((F.col("sign") + 1) / 2).cast("double").alias("y"), "weight").join(text_model.difference_rows(pairs, vectors, terms), "pair_id")
    return kept(rows, "text-rows"), terms.count()


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations with their split side, and P(i) of each test observation by the pooled and the group's head of its split and aspect."""
    obs = kept(observations(spark, sf_dir), "text-obs")
    rows, size = features(spark, sf_dir, obs)
    splits = kept(resample.prompt_split(obs, "prompt_id", inference.SPLITS, inference.TEST_SHARE, inference.SEED), "text-splits")
    sided = kept(obs.join(splits, "prompt_id"), "text-sided")
    head = lambda scope: F.concat_ws("|", F.col("split").cast("string"), "aspect", scope)
    both = sided.withColumn("_heads", F.array(F.struct(head(F.lit("all")).alias("head"), F.lit("pooled").alias("kind")), F.struct(head(F.col("annotation_group")).alias("head"), F.lit("group").alias("kind")))).withColumn("_h", F.explode("_heads")).select("pair_id", "split", "is_test", "_h.head", "_h.kind")
    members = both.where("not is_test").select("head", "pair_id")
    coefficients = kept(logistic_heads.fit_heads(rows, members, members.select("head").distinct(), "pair_id", max(size, 1)), "text-heads")
    asked = both.where("is_test").select("head", "pair_id")
    found = logistic_heads.predict(rows, asked, coefficients, "pair_id").join(both.where("is_test").select("head", "pair_id", "split", "kind"), ["head", "pair_id"])
    wide = found.groupBy("pair_id", "split").agg(F.max(F.when(F.col("kind") == "pooled", F.col("p"))).alias("p_pooled"), F.max(F.when(F.col("kind") == "group", F.col("p"))).alias("p_group"))
    return sided, kept(sided.where("is_test").join(wide, ["pair_id", "split"]), "text-predicted")


LOSSES = ("log_loss", "brier", "error", "pair_calibration", "majority_error")


def edge_sums(tested: DataFrame, keys: list[str], p: str, prefix: str) -> DataFrame:
    """Sums over a pair's test observations (log loss, Brier, error) and the pair's own losses, times its weight."""
    q = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col(p)))
    y, w = (F.col("sign") > 0).cast("double"), F.col("weight")
    sums = tested.groupBy(*keys, "i", "j").agg(
        F.sum("weight").alias("weight"), F.sum(-w * (y * F.log(q) + (1 - y) * F.log(1 - q))).alias(f"{prefix}_log_loss"), F.sum(w * (q - y) ** 2).alias(f"{prefix}_brier"),
        F.sum(w * ((q >= 0.5) != (y > 0.5)).cast("double")).alias(f"{prefix}_error"), (F.sum(w * y) / F.sum("weight")).alias("_o"), (F.sum(w * q) / F.sum("weight")).alias("_q"),
    )
    even = (F.abs(2 * F.col("_o") - 1) <= 1e-9) | (F.abs(2 * F.col("_q") - 1) <= 1e-9)
    missed = F.when(even, 0.5).when((F.col("_o") > 0.5) != (F.col("_q") > 0.5), 1.0).otherwise(0.0)
    return sums.withColumns({f"{prefix}_pair_calibration": F.col("weight") * F.abs(F.col("_o") - F.col("_q")), f"{prefix}_majority_error": F.col("weight") * missed}).drop("_o", "_q")


def text_regions(spark: SparkSession, sf_dir: str, min_support: float = 5, min_test_weight: float = 5, min_test_edges: int = 2) -> DataFrame:
    """A row for each split, scope (a group), aspect and triplet of models: the training flow's residual and cycle, and held-out losses of the pooled
    and of the group's head; with how many regions of the scope were left out for lack of test rows."""
    sided, tested = predictions(spark, sf_dir)
    keys = regions.KEYS
    train = scoped_edge_flow(sided.where("not is_test"), ["split", "aspect"], "annotation_group").where("scope <> 'all'")
    tri = regions.trained_triplets(train, min_support).select(*regions.REGION, "rho", "cyclic", F.least("s_ij", "s_jk", "s_ik").alias("min_support"))
    named = tested.where("p_group is not null and p_pooled is not null").withColumnRenamed("annotation_group", "scope")
    sums = edge_sums(named, keys, "p_pooled", "pooled").join(edge_sums(named, keys, "p_group", "group").drop("weight"), [*keys, "i", "j"]).withColumnsRenamed({"i": "a", "j": "b"})
    arcs = tri.select("*", F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("i", "j"), ("j", "k"), ("i", "k"))])).alias("_e")).select(*tri.columns, "_e.*")
    columns = [f"{k}_{m}" for k in ("pooled", "group") for m in LOSSES]
    met = arcs.join(sums, [*keys, "a", "b"], "left").groupBy(*tri.columns).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("test_weight"), F.count("weight").alias("test_edges"), *[F.try_divide(F.sum(c), F.sum("weight")).alias(c) for c in columns])
    fine = (F.col("test_weight") >= min_test_weight) & (F.col("test_edges") >= min_test_edges)
    return met.withColumn("eligible", fine)


def group_heads(spark, sf_dir):
    """By aspect, scope and loss: weighted losses of pooled and group heads over eligible regions, what routing the quarter of highest residual to group
    heads gains, and how many regions weren't eligible."""
    rows = kept(text_regions(spark, sf_dir), "text-regions")
    stacked = ", ".join(f"'{m}', pooled_{m}, group_{m}" for m in LOSSES)
    fine = rows.where("eligible").select("scope", "aspect", "rho", "test_weight", F.expr(f"stack({len(LOSSES)}, {stacked}) as (metric, pooled, grouped)"))
    cut = regions.quantiles(rows.where("eligible"), ["scope", "aspect"], "rho", {"_cut": 0.75})
    w = F.col("test_weight")
    mean = lambda x: F.try_divide(F.sum(w * x), F.sum(w))
    routed = F.when(F.col("rho") >= F.col("_cut"), F.col("grouped")).otherwise(F.col("pooled"))
    out = fine.join(cut, ["scope", "aspect"]).groupBy("scope", "aspect", "metric").agg(F.count("*").alias("regions"), mean(F.col("pooled")).alias("pooled"), mean(F.col("grouped")).alias("group_head"), mean(routed).alias("routed"))
    skipped = rows.groupBy("scope", "aspect").agg(F.count_if(~F.col("eligible")).alias("skipped"))
    return out.join(skipped, ["scope", "aspect"]).withColumns({"improvement": F.col("pooled") - F.col("group_head"), "routed_improvement": F.col("pooled") - F.col("routed")})


QUERIES = {"text_regions": text_regions, "group_heads": group_heads}
ORACLE_SQL: dict[str, str] = {}
