"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets. The mix holds ``share`` times all words. Sources in code-point order (null last) carry the repeating
``weights`` and share that total; a source's target stops at ``max_epochs`` times its size and the excess goes to the
others by weight until none is above. With sources ordered by cap/weight that is one level ``L``: target =
min(cap, L * weight), where ``L`` is the largest of (total - caps so far) / (weights left).

Selection. ``floor(target / size)`` complete epochs come first. The rest of a target is filled in the order of
exponential keys -ln(u) / quality weight (u from a hash of the id), up to the budget; the document on the budget's edge
gives its first words only, so that each source's total is its rounded target.

Scale. One source may hold most rows, so no task ever holds a source: keys are cut into ``KEY_BUCKETS`` ranges, sizes
are pre-aggregated by (source, range), prefix sums run over ranges, and only the range on the budget's edge
(1/4096 of a source) is sorted by key.

Edge cases: a null text or one without words has size 0 and is taken 0 times; a null source is a source of its own, the
last; null ids share one key and ties are broken by id, then by a hash of the text; repeated rows count as often as they
occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefgraph.llm.common import staged, word_count

KEY_BUCKETS = 4096
#: Quality weight of documents labelled good or bad; those without a label weigh 1.
GOOD, BAD = 2.0, 0.5


def uniform(identity: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of seed and id: the same on every run and in any SQL engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(identity.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels; repeated labels of a document are averaged, null ids or labels are left out."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.lit(BAD) + (GOOD - BAD) * F.avg(F.col("quality").cast("double"))).alias("weight"))
    )


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target, epochs, rest): one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("_w", F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))).withColumn(
        "_cap", max_epochs * F.col("source_size").cast("double")
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    return (
        weighed.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, text_hash, size, source_size, target, epochs, taken (words).

    ``quality`` is (doc_id, weight > 0), unique by doc_id; documents that it lacks weigh 1.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        word_count(F.col(text_col)).alias("size"),
    )
    if quality is not None:
        rows = rows.join(quality.select("doc_id", "weight"), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    # u ** (1 / weight) falls as the exponential key rises
    rows = rows.withColumn("_u", F.pow(uniform(F.col("doc_id"), seed), 1.0 / F.coalesce(F.col("weight"), F.lit(1.0)))).drop("weight")
    rows = staged(rows.withColumn("_range", F.least(F.floor((1 - F.col("_u")) * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1)).cast("int")), "mix")

    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    ranges = staged(ranges, "mix-ranges")
    targets = staged(source_targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_epochs), "mix-targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    running = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    edges = (
        sums.join(targets, same(sums, targets))
        .where("_before <= rest and rest < _before + _words")
        .select(sums["source"], F.col("_range").alias("_edge"), (F.col("rest") - F.col("_before")).alias("_left"))
    )
    plan = targets.join(edges, same(targets, edges), "left").select(
        targets["source"], "source_size", "target", "epochs", F.coalesce("_edge", F.when(F.col("rest") > 0, F.lit(KEY_BUCKETS)).otherwise(F.lit(-1))).alias("_edge"), "_left"
    )
    joined = rows.join(plan, same(rows, plan)).select(rows["*"], "source_size", "target", "epochs", "_edge", "_left")
    whole = joined.where("_range <> _edge").withColumn("_part", F.when(F.col("_range") < F.col("_edge"), F.col("size")).otherwise(F.lit(0)))
    in_order = Window.partitionBy("source").orderBy(F.desc("_u"), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        joined.where("_range = _edge")
        .withColumn("_done", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        .withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_done"))))
        .drop("_done")
    )
    return whole.unionByName(edge).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("_part")).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs`` (doc_id, text, source and others).

    A document appears once for every complete epoch; a fraction adds a copy of its first words (white space kept).
    Documents of which nothing is taken are left out. ``n_chars``, if there, follows the text.
    """
    shares = mix(docs, quality, **options).where("taken > 0").groupBy("doc_id", "source", "text_hash").agg(F.first("size").alias("_size"), F.first("epochs").alias("_epochs"), F.sum(F.col("taken") - F.col("epochs") * F.col("size")).alias("_parts"), F.count("*").alias("_rows"))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    same_row = keyed["doc_id"].eqNullSafe(shares["doc_id"]) & keyed["source"].eqNullSafe(shares["source"]) & (keyed["_hash"] == shares["text_hash"])
    chosen = keyed.join(shares, same_row).select(keyed["*"], "_size", "_epochs", "_parts", "_rows")
    # equal rows share what was taken beyond the epochs evenly, rounded to words
    extra = F.least(F.col("_size"), F.round(F.col("_parts") / F.col("_rows")).cast("long"))
    cut = F.when(extra >= F.col("_size"), F.col("text")).otherwise(first_words(F.col("text"), extra))
    copies = F.concat(F.array_repeat(F.col("text"), F.col("_epochs").cast("int")), F.when(extra > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = chosen.withColumn("_copies", copies).withColumn("_copy", F.explode("_copies"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("_copy").alias("text"))
        elif name == "n_chars":
            columns.append(F.char_length("_copy").cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(name))
    return out.select(*columns)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")
