"""Splits, bootstraps, permutations and null draws, keyed by rep and hashed, so that reruns agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from prefgraph.functions.draws import binomials, mixed
from prefgraph.functions.hashing import hash_int, uniform
from prefgraph.functions.ranking import distributed_rank
from prefgraph.operators.ordering import kept


def times(df: DataFrame, name: str, n: int) -> DataFrame:
    """Every row n times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


#: Leading bits of hashes that are counted to find a split's last test prompt.
CUT_BITS = 12


def split_cuts(keys: DataFrame, key: str, n_splits: int, share: float, seed: int) -> DataFrame:
    """(split, _h, _last): the hash and the key of the last test prompt of every split, in the order of (hash, key); ``keys`` is read three times.

    Leading bits of the hashes are counted, and only keys of the range that holds the wanted rank (one in 4,096) are put in order.
    """
    hashed = times(keys.select(key), "split", n_splits).withColumn("_h", hash_int(seed, F.col("split"), F.col(key))).withColumn("_r", F.shiftright("_h", 32 - CUT_BITS))
    counts = kept(hashed.groupBy("split", "_r").agg(F.count("*").alias("_n")), "split-ranges")  # splits x ranges
    sizes = counts.groupBy("split").agg(F.greatest(F.lit(1), F.bround(F.sum("_n") * share)).alias("_most"))
    upto = counts.join(sizes, "split").withColumn("_upto", F.sum("_n").over(Window.partitionBy("split").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    # one range a split
    at = upto.where((F.col("_upto") >= F.col("_most")) & (F.col("_upto") - F.col("_n") < F.col("_most"))).select("split", "_r", (F.col("_most") - F.col("_upto") + F.col("_n")).alias("_place"))
    inside = hashed.join(F.broadcast(at), ["split", "_r"]).withColumn("_k", F.row_number().over(Window.partitionBy("split").orderBy("_h", key)))
    return inside.where("_k = _place").select("split", "_h", F.col(key).alias("_last"))


def prompt_split(prompts: DataFrame, key: str, n_splits: int, share: float, seed: int) -> DataFrame:
    """(key, split, is_test): in every split round(share * n) prompts, one at least, are for testing: the first by hash."""
    keys = kept(prompts.select(key).distinct(), "split-keys")
    cuts = kept(split_cuts(keys, key, n_splits, share, seed), "split-cuts")
    rows = times(keys, "split", n_splits).withColumn("_x", hash_int(seed, F.col("split"), F.col(key)))
    # a row a split
    return rows.join(F.broadcast(cuts), "split").select(key, "split", ((F.col("_x") < F.col("_h")) | ((F.col("_x") == F.col("_h")) & F.coalesce(F.col(key) <= F.col("_last"), F.col(key).isNull()))).alias("is_test"))


def user_bootstrap(user_edges: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, i, j, margin, support) of resampled users; ``user_edges``: user_id, i, j, um.

    Users are drawn by number, comparisons are never read again: a user's draws over all resamples and their pairs are a row each, and a task adds up its users as one
    product of matrices (resamples x users x pairs; pairs are at most the square of the alternatives).
    """
    user_edges = kept(user_edges, "user-edges")
    listed = sorted((r["i"], r["j"]) for r in user_edges.select("i", "j").distinct().collect())
    spark, size = user_edges.sparkSession, len(listed)
    numbers = spark.createDataFrame([(i, j, k) for k, (i, j) in enumerate(listed)], StructType([user_edges.schema["i"], user_edges.schema["j"], StructField("k", IntegerType())]))
    users = distributed_rank(user_edges.select("user_id").distinct().withColumn("_all", F.lit(0)), ["_all"], hash_int(seed, F.col("user_id")), "user_id", "slot")
    n = users.groupBy("_all").agg(F.count("*").alias("n"))
    draws = times(users.join(n, "_all").select("slot", "n"), "rep", reps)
    drawn = draws.select("rep", (F.floor(uniform(seed, F.col("rep"), F.col("slot")) * F.col("n")) + 1).alias("slot")).groupBy("slot", "rep").agg(F.count("*").cast("int").alias("times"))
    of_slot = drawn.groupBy("slot").agg(F.collect_list("rep").alias("reps"), F.collect_list("times").alias("times"))
    of_user = user_edges.join(F.broadcast(numbers), ["i", "j"]).groupBy("user_id").agg(F.collect_list("k").alias("pairs"), F.collect_list("um").alias("ums"))
    rows = of_slot.join(users.select("slot", "user_id"), "slot").join(of_user, "user_id").select("reps", "times", "pairs", "ums")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((reps, size)), np.zeros((reps, size))
        for batch in batches:
            reps_, times_, pairs_, ums_ = (batch.column(c) for c in ("reps", "times", "pairs", "ums"))
            owner = lambda c: np.repeat(np.arange(batch.num_rows), np.diff(c.offsets.to_numpy()))  # noqa: E731, B023
            copies, values, there = np.zeros((reps, batch.num_rows)), np.zeros((batch.num_rows, size)), np.zeros((batch.num_rows, size))
            copies[reps_.flatten().to_numpy(), owner(reps_)] = times_.flatten().to_numpy()
            at = owner(pairs_), pairs_.flatten().to_numpy()
            values[at], there[at] = ums_.flatten().to_numpy(), 1.0
            total += copies @ values
            count += copies @ there
        if count.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(count.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["rep", "total", "count"])

    sums = rows.mapInArrow(add, "rep int, total array<double>, count array<long>").select("rep", F.posexplode(F.arrays_zip("total", "count")).alias("k", "_p")).groupBy("rep", "k").agg(F.sum("_p.total").alias("_t"), F.sum("_p.count").alias("support")).where("support > 0")
    return sums.join(F.broadcast(numbers), "k").select("rep", "i", "j", (F.col("_t") / F.col("support")).alias("margin"), "support")


def permuted_groups(users: DataFrame, group: str, reps: int, seed: int) -> DataFrame:
    """(rep, user columns, group): users are dealt anew to groups of the same sizes."""
    sizes = users.groupBy(group).agg(F.count("*").alias("_n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    slots = distributed_rank(users.select("user_id", group), [group], hash_int(seed, F.col("user_id")), "user_id", "_k")
    slots = slots.join(starts, group).select(group, (F.col("_start") + F.col("_k")).alias("position"))
    dealt = distributed_rank(times(users.drop(group), "rep", reps), ["rep"], hash_int(seed, F.col("rep"), F.col("user_id")), "user_id", "position")
    return dealt.join(slots, "position").drop("position")


def stratified_permutation(rows: DataFrame, strata: list[str], key: str, value: str, reps: int, seed: int) -> DataFrame:
    """(rep, strata, key, value): values are shuffled among the keys of a stratum."""
    base = distributed_rank(rows.select(*strata, key), strata, hash_int(seed, F.col(key)), key, "_p")
    dealt = distributed_rank(times(rows.select(*strata, F.col(key).alias("_from"), value), "rep", reps), [*strata, "rep"], hash_int(seed, F.col("rep"), F.col("_from")), "_from", "_p")
    return dealt.join(base, [*strata, "_p"]).drop("_p", "_from")


def binomial(rows: DataFrame, n: str, p: str, keys: list[Column], seed: int, name: str = "wins") -> DataFrame:
    """Adds a binomial draw to each row, made from the hash of the row's keys alone, a batch at a time."""

    names = rows.columns

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, counts, chances = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_seed", n, p))
            wins = binomials(mixed(seeds.astype(np.uint64)), counts, chances)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(wins)], [*names, name])

    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.withColumn("_seed", hash_int(seed, *keys)).mapInArrow(draw, f"{fields}, {name} long")
