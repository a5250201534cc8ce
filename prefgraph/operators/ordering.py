"""Order without a task that holds a scope: numbers, ranks with ties, suffix minima and exact quantiles of any number of rows.

Ranges. Rows (or distinct values with their counts) are dealt to ranges of the order once and written with their range's number, so that every later
step reads the same ranges: nothing is dealt twice with other bounds, and a task that is repeated finds the same rows. Ranges are counted, offsets come from sums
over ranges, and only rows of one range and scope are ever ordered together.

Quantiles. Mergeable sketches give brackets around the wanted ranks, counts say exactly how many rows lie below and inside, and only rows inside
go on; brackets that still hold many rows are cut again.

Rows whose key columns are null are left out of quantiles; in the others nulls are a scope of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefgraph.sources.scans import scratch

#: Rows that a range holds on average, and rows that one task may order for a quantile.
RANGE, INSIDE = 500_000, 200_000
ACCURACY = 5_000


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written where the cluster keeps checkpoints, and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal each other; the keys of ``a`` stay."""
    other = b.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    alike = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return a.join(other, reduce(lambda x, y: x & y, alike), how).drop(*[f"_other_{k}" for k in keys])


def in_ranges(df: DataFrame, keys: list[str], order: list, rows_a_range: int = RANGE, ranges: int | None = None) -> DataFrame:
    """``df`` with _range, rising with (keys, order): written once, so that ranges are the same for whoever reads it."""
    n = ranges or max(1, -(-df.count() // rows_a_range))
    return kept(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _before(totals: DataFrame, keys: list[str], sums: dict[str, Column], back: bool = False) -> DataFrame:
    """Sums over the ranges before each, a row for each range of a scope: as many as ranges and scopes together."""
    place = F.desc("_range") if back else F.asc("_range")
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_range", *[c.over(w).alias(n) for n, c in sums.items()])


def numbered(df: DataFrame, order: list[str] | str, name: str, keys: list[str] = (), rows_a_range: int = RANGE, ranges: int | None = None) -> DataFrame:
    """Adds the row's number from 0 in the order of columns that are unique within keys."""
    order, keys = [order] if isinstance(order, str) else list(order), list(keys)
    rows = in_ranges(df, keys, order, rows_a_range, ranges)
    starts = _before(rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n")), keys, {"_start": F.sum("_n")})
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    out = _join(inside, starts, [*keys, "_range"])
    return out.withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_k") - 1).drop("_range", "_k", "_start")


def value_places(df: DataFrame, keys: list[str], value: str, rows_a_range: int = RANGE, ranges: int | None = None, copies: str | None = None) -> DataFrame:
    """(keys, value, _count, _below, _range): each distinct value once, with the rows that have it and those with smaller ones. A value that a third of
    all rows share is counted where the rows are and is one row here. ``copies``: how often a row counts."""
    rows = in_ranges(df.groupBy(*keys, value).agg((F.sum(copies) if copies else F.count("*")).alias("_count")), keys, [value], rows_a_range, ranges)
    starts = _before(rows.groupBy(*keys, "_range").agg(F.sum("_count").alias("_n")), keys, {"_start": F.sum("_n")})
    w = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_count").over(w), F.lit(0)))
    return _join(inside, starts, [*keys, "_range"]).withColumn("_below", F.col("_inside") + F.coalesce("_start", F.lit(0))).drop("_inside", "_start")


def average_ranks(df: DataFrame, keys: list[str], columns: dict[str, str], rows_a_range: int = RANGE, ranges: int | None = None, copies: str | None = None) -> DataFrame:
    """Adds for each column the 1-based rank within keys, ties averaged; ``columns``: name of the rank by column."""
    for value, name in columns.items():
        places = value_places(df, keys, value, rows_a_range, ranges, copies)
        ranks = places.select(*keys, value, (F.col("_below") + (F.col("_count") + 1) / 2).alias(name))
        df = _join(df, ranks, [*keys, value])
    return df


def adjusted(df: DataFrame, keys: list[str], p: str, name: str = "q", rows_a_range: int = RANGE, ranges: int | None = None) -> DataFrame:
    """Adds the Benjamini-Hochberg q of p within keys; rows without p keep a null q and don't count.

    Equal p have equal q: that of the last one of them. The least p n / k of all larger p is a suffix minimum, within ranges and over them.
    """
    places = kept(value_places(df.where(F.col(p).isNotNull()), keys, p, rows_a_range, ranges), "places")
    totals = places.groupBy(*keys).agg(F.sum("_count").alias("_n"))
    totals = _join(places, totals, keys) if keys else places.join(F.broadcast(totals))  # without keys one row
    step = totals.withColumn("_v", F.col(p) * F.col("_n") / (F.col("_below") + F.col("_count")))
    later = _before(step.groupBy(*keys, "_range").agg(F.min("_v").alias("_v")), keys, {"_later": F.min("_v")}, back=True)
    w = Window.partitionBy(*keys, "_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_v").over(w))
    values = _join(step.withColumn("_q", q), later, [*keys, "_range"]).select(*keys, p, F.least("_q", "_later").alias(name))
    return _join(df, values, [*keys, p], "left")


def _picked(inside: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The values at ranks _lo and _hi (from 0) of each (keys, _q): a row for each, from the rows inside its bracket."""
    counts = inside.groupBy(*keys, "_q", "_below", "_lo", "_hi", x).agg(F.count("*").alias("_count"))
    w = Window.partitionBy(*keys, "_q").orderBy(x)
    upto = counts.withColumn("_upto", F.col("_below") + F.sum("_count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda k: F.min(F.when(F.col("_upto") > F.col(k), F.col(x)))
    return upto.groupBy(*keys, "_q").agg(at("_lo").alias("_vlo"), at("_hi").alias("_vhi"))


def quantiles(df: DataFrame, keys: list[str], x: str, wanted: dict[str, float], inside: int = INSIDE, accuracy: int = ACCURACY) -> DataFrame:
    """(keys, one column for each of ``wanted``): exact quantiles of the non-null values, linear between neighbours.

    A task orders at most the distinct values within a bracket, of about ``inside`` rows.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    names = list(wanted)
    margin = 2.0 / accuracy
    around = lambda p: (max(0.0, p - margin), min(1.0, p + margin))
    sketch = F.percentile_approx("_x", [e for p in wanted.values() for e in around(p)], accuracy)
    per = rows.groupBy(*keys).agg(F.count("*").alias("_n"), sketch.alias("_s"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    rank = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    targets = [
        F.struct(F.lit(q).alias("_q"), F.floor(rank(p)).alias("_lo"), F.ceil(rank(p)).alias("_hi"), (rank(p) - F.floor(rank(p))).alias("_f"), F.when(F.lit(around(p)[0] == 0.0), F.col("_min")).otherwise(F.col("_s")[2 * k]).alias("_a"), F.when(F.lit(around(p)[1] == 1.0), F.col("_max")).otherwise(F.col("_s")[2 * k + 1]).alias("_b"))
        for k, (q, p) in enumerate(wanted.items())
    ]
    brackets = kept(per.select(*keys, "_n", "_min", "_max", F.explode(F.array(*targets)).alias("_t")).select(*keys, "_n", "_min", "_max", "_t.*"), "brackets")
    done = []
    for turn in range(64):
        met = rows.join(brackets, keys) if keys else rows.join(F.broadcast(brackets))  # without keys: a row for each wanted one
        same = [*keys, "_q", "_lo", "_hi", "_f", "_n", "_min", "_max", "_a", "_b"]
        lies = met.groupBy(*same).agg(F.count_if(F.col("_x") < F.col("_a")).alias("_below"), F.count_if((F.col("_x") >= F.col("_a")) & (F.col("_x") <= F.col("_b"))).alias("_in"))
        # a sketch that missed: everything on that side is taken in
        holds = (F.col("_below") <= F.col("_lo")) & (F.col("_hi") < F.col("_below") + F.col("_in"))
        lies = kept(lies.withColumn("_holds", holds), "brackets")
        small = F.col("_holds") & ((F.col("_in") <= inside) | (F.col("_a") == F.col("_b")) | F.lit(turn >= 8))
        ready, rest = lies.where(small), lies.where(~small)
        got = rows.join(ready, keys) if keys else rows.join(F.broadcast(ready))
        done.append(_join(_picked(got.where("_x between _a and _b"), keys, "_x"), ready.select(*keys, "_q", "_f"), [*keys, "_q"]))
        if rest.limit(1).count() == 0:
            break
        missed = rest.where("not _holds")
        wider = missed.select(*keys, "_n", "_min", "_max", "_q", "_lo", "_hi", "_f", F.when(F.col("_below") > F.col("_lo"), F.col("_min")).otherwise(F.col("_a")).alias("_a"), F.when(F.col("_below") + F.col("_in") <= F.col("_hi"), F.col("_max")).otherwise(F.col("_b")).alias("_b"))
        # brackets that hold too many rows: cut at the ranks within them
        large = rest.where("_holds")
        within = (rows.join(large, keys) if keys else rows.join(F.broadcast(large))).where("_x between _a and _b")
        cuts = [k / 1000 for k in range(1001)]
        fine = within.groupBy(*keys, "_n", "_min", "_max", "_q", "_lo", "_hi", "_f", "_a", "_b", "_below", "_in").agg(F.percentile_approx("_x", cuts, accuracy).alias("_s"))
        place = lambda r: F.least(F.lit(1000), F.greatest(F.lit(0), r)).cast("int")
        lo, hi = F.floor((F.col("_lo") - F.col("_below")) / F.col("_in") * 1000) - 1, F.ceil((F.col("_hi") - F.col("_below")) / F.col("_in") * 1000) + 1
        narrower = fine.select(*keys, "_n", "_min", "_max", "_q", "_lo", "_hi", "_f", F.when(lo <= 0, F.col("_a")).otherwise(F.get("_s", place(lo))).alias("_a"), F.when(hi >= 1000, F.col("_b")).otherwise(F.get("_s", place(hi))).alias("_b"))
        brackets = kept(wider.unionByName(narrower), "brackets")
    values = reduce(DataFrame.unionByName, done)
    value = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")
    pick = lambda q: F.max(F.when(F.col("_q") == q, F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(value))).alias(q)
    return values.groupBy(*keys).agg(*[pick(q) for q in names])


