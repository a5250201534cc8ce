"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

Sets. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds the 64-bit hashes of its distinct
five-word shingles, or of its whole sequence if it has fewer words. Rows with equal sets form one class, and all later
work is on classes.

Candidates. The sorted hashes are cut into equal ranges, each range's least hash is its sketch, and an empty
range borrows from the first filled one in its own fixed random order. Bands of ``ROWS`` ranges give bucket
keys; there are as many (``bands_for``) as it takes for a pair at the threshold to share no bucket with probability ``MISSED`` at most:
25 at 0.85 (0.5563 ** 25 = 4e-7), 37 at 0.80.

Edges. A bucket's members are paired with one pivot, never with each other: a star. The ``FIRST`` bands' stars come first and put
most copies together; then each bucket that holds several components gets a star from a member of its largest one to the
members of others, so that a group of n copies has a few times n links, however many bands they share. A member that the pivot
didn't link can still be near another one, so buckets that hold more than one component after that go on: the members
outside the bucket's largest component, first ``EARLY`` of them, then at most ``PIVOTS`` a round, become pivots for the members of other components,
and are exhausted then; those with the fewest shingles of their own come first, since they are nearest to what a group has in common, so that few links join
most of it. A pair is only made in the first bucket that it shares. So every pair of one bucket is either tested or already in one component when the rounds end, and
pairs within a component are never made.

Tests. Shingles that only one candidate class holds are counted: n of them aside, a class can share no more than the rest
with any other. Classes that can't reach the similarity with anything leave, and pairs are made only if the smaller rest would
do; such bounds are exact. Then pairs go that agree in fewer than ``agree_for`` of ``BITS`` one-bit minima: the limit is 5.3 standard
deviations below the mean at the threshold (902 below 947 at 0.85, 870 below 922 at 0.80), so that a link is lost less often than by
sharing no band. Where pivots meet members, the ``LEAST`` least hashes of both are compared as well: sets that have fewer are there as a whole, so that the
comparison is exact; of longer ones, those of the union's least hashes that both hold are a sample of the similarity, with a limit of the same deviations.
These tests are made where pairs are, so crowds of texts that each differ from a common original by more than the threshold allows give no pairs: what is
made there are links. All pairs are confirmed on full sets.

Edge cases: null and word-less texts have empty sets, n_shingles 0, and are linked with nothing; rows with null ids
belong to their class, but don't name it (a class of null ids only has component_id null and is kept); repeated rows are
one class and keep = (doc_id = component_id) holds for each row with the smallest id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefgraph.llm.common import shared_dir, ship_package, staged, tidy

SHINGLE = 5
BINS, ROWS = 125, 5
EARLY, PIVOTS, BITS, LEAST = 8, 256, 1024, 1024
#: Bands whose stars are made before it is known which classes belong together.
FIRST = 2
#: How often a pair at the threshold shares no band, at most, and standard deviations from the mean to the limit of one-bit minima.
MISSED, DEVIATIONS = 4.5e-7, 5.3
_TRIES = 2048


def bands_for(percent: int) -> int:
    """Bands that leave a pair at the threshold without a common one with probability ``MISSED`` at most."""
    s = percent / 100
    return 1 if s >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(s**ROWS)))


def agree_for(percent: int) -> int:
    """One-bit minima in which a pair at the threshold agrees but for ``DEVIATIONS`` standard deviations."""
    p = (1 + percent / 100) / 2
    return math.floor(BITS * p - DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def both_for(percent: int) -> int:
    """Of the ``LEAST`` least hashes of a union, how many both sets of a pair at the threshold hold but for ``DEVIATIONS`` standard deviations."""
    p = percent / 100
    return math.floor(LEAST * p - DEVIATIONS * math.sqrt(LEAST * p * (1 - p)))


def similar(a: str, b: str, percent: int) -> str:
    """Whether two sets can reach the similarity, by their least hashes; exact for sets of fewer than ``LEAST``."""
    both, union = f"array_intersect({a}, {b})", f"slice(array_sort(array_union({a}, {b})), 1, {LEAST})"
    whole = f"{100 + percent} * size({both}) >= {percent} * (size({a}) + size({b}))"
    return f"case when size({a}) < {LEAST} and size({b}) < {LEAST} then {whole} else size(array_intersect({both}, {union})) >= {both_for(percent)} end"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, only ASCII white space
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    h = hashed[:n].copy()
    for j in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += hashed[j : n + j]
    return np.unique(_mixed(h))


_orders: dict[int, np.ndarray] = {}


def _borrow_order(bins: int) -> np.ndarray:
    """For each range, the fixed random order in which it asks others."""
    if bins not in _orders:
        _orders[bins] = np.random.Generator(np.random.PCG64(20240229)).integers(0, bins, (bins, _TRIES), dtype=np.int16)
    return _orders[bins]


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of each range, empty ranges filled by optimal densification; for a set that isn't empty."""
    edges = (np.arange(1, bins, dtype=np.float64) * (2.0**64 / bins)).astype(np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))
    filled = cuts[:-1] < cuts[1:]
    least = hashes[np.minimum(cuts[:-1], len(hashes) - 1)]
    empty = np.flatnonzero(~filled)
    order, at, step = _borrow_order(bins), 0, 16
    while len(empty) and at < _TRIES:
        asked = order[empty, at : at + step]
        ok = filled[asked]
        found = ok.any(axis=1)
        least[empty[found]] = least[asked[found, ok[found].argmax(axis=1)]]
        empty, at, step = empty[~found], at + step, step * 4
    if len(empty):
        least[empty] = hashes[0]
    return least


def one_bits(hashes: np.ndarray) -> list[int]:
    """One bit of each of ``BITS`` minima, as longs."""
    low = _mixed(sketch(hashes, BITS) + np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8)).view(np.int64).tolist()


def band_keys(parts: np.ndarray) -> np.ndarray:
    """One bucket key per band of a sketch; the band is part of the key."""
    parts = parts.reshape(-1, ROWS)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        key = _mixed(key ^ parts[:, j]) + np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _describe(percent: int):
    bins = bands_for(percent) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, names, bands = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text)
                sizes.append(len(hashes))
                names.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                bands.append(band_keys(sketch(hashes, bins)) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_name", "bands"],
            )

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [np.frombuffer(b, np.int64) for b in batch.column("hashes").to_pylist()]
        owner = np.repeat(batch.column("class").to_numpy(), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        for at in range(0, len(flat), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(owner[at : at + 100_000]), pa.array(flat[at : at + 100_000])], ["class", "shingle"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
        names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        bits = [one_bits(s) if len(s) else None for s in sets]
        least = pa.array([np.sort(s.view(np.int64))[:LEAST] for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(bits, pa.list_(pa.int64())), least, pa.array([s.tobytes() for s in sets], pa.binary())], ["set_name", "bits", "least", "hashes"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, xs, ys = [], batch.column("x_set"), batch.column("y_set")
            for k in range(batch.num_rows):  # sets are views of the batch
                x, y = (np.frombuffer(sets[k].as_buffer(), np.uint64) for sets in (xs, ys))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["x", "y"]).filter(pa.array(linked, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(x, y) links of longs to (node, component): the smallest node reachable. Label spreading with pointer jumping, so
    the number of rounds grows with the logarithm of a chain's length."""
    shared_dir(links.sparkSession)
    both = links.select(F.col("x").alias("node"), F.col("y").alias("other")).union(links.select("y", "x")).where("node <> other").distinct().checkpoint()
    labels = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")).checkpoint()
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("other_label"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("other_label").alias("near"))
        pulled = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = pulled.join(jumps, "label", "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")).checkpoint()
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, component, text_key) for each row of ``docs``; links where 100 |A and B| >= percent |A or B|.

    Ids may repeat over different texts: ``component`` numbers the components themselves (null for empty sets), and ``text_key`` is the
    text's hash, by which rows of one id are told apart.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = staged(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(tidy(_describe(percent)), "doc_id long, text_key long, n_shingles long, set_name binary, bands array<long>"), "dedup-rows")
    classes = staged(
        described.where("n_shingles > 0")
        .groupBy("set_name")
        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("class", F.monotonically_increasing_id()),
        "dedup-classes",
    )
    spread = classes.select("class", "n", F.posexplode("bands").alias("band", "bucket"))
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("_size")).where("_size > 1").select("bucket")
    wanted_ids = spread.join(crowded, "bucket").select("class").distinct()

    wanted = staged(classes.drop("bands").join(wanted_ids, "class", "left_semi"), "dedup-wanted")
    one_row = described.select("doc_id", "set_name").join(wanted.select("set_name", "first_id", "class"), "set_name").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id").distinct()
    texts = rows.join(one_row, rows["doc_id"].eqNullSafe(one_row["doc_id"]), "left_semi")
    sets = texts.select("text").mapInArrow(tidy(_full_sets), "set_name binary, bits array<long>, least array<long>, hashes binary")
    sets = staged(sets.join(wanted.select("set_name", "class"), "set_name").dropDuplicates(["class"]).select("class", "bits", "least", "hashes"), "dedup-sets")

    flat = sets.select("class", "hashes").mapInArrow(tidy(_shingles), "class long, shingle long")
    alone = flat.groupBy("shingle").agg(F.min("class").alias("class"), F.count("*").alias("_k")).where("_k = 1").groupBy("class").agg(F.count("*").alias("_alone"))
    rest = F.col("n") - F.coalesce("_alone", F.lit(0))
    alive = wanted.select("class", "n").join(alone, "class", "left").select("class", "n", rest.alias("rest")).where(f"100 * rest >= {percent} * n")
    living = spread.drop("n").join(alive, "class")
    shared = living.groupBy("bucket").agg(F.count("*").alias("_size")).where("_size > 1").select("bucket")
    members = staged(living.join(shared, "bucket"), "dedup-members")

    agree = lambda a, b: " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(BITS // 64)) + f" <= {BITS - agree_for(percent)}"

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("x", "y").distinct()
        side = lambda name, what: sets.select(F.col("class").alias(name), F.col(what).alias(f"{name}_{what}"))
        near = pairs.join(side("y", "bits"), "y").join(side("x", "bits"), "x").where(agree("x_bits", "y_bits")).select("x", "y")
        full = near.join(side("y", "hashes"), "y").join(side("x", "hashes"), "x")
        return staged(full.select("x", "y", F.col("x_hashes").alias("x_set"), F.col("y_hashes").alias("y_set")).mapInArrow(tidy(_confirm(percent)), "x long, y long"), "dedup-links")

    # the member with the fewest shingles of its own
    central = F.min(F.struct((F.col("n") - F.col("rest")).alias("own"), "class", "n", "rest")).alias("p")
    reach = lambda n, r: f"100 * least(rest, {r}) >= {percent} * (n + {n} - least(rest, {r}))"
    pivots = members.where(F.col("band") < FIRST).groupBy("bucket").agg(central)
    starred = members.join(pivots, "bucket").where("class <> p.class and " + reach("p.n", "p.rest"))
    links = confirmed(starred.select(F.col("p.class").alias("x"), F.col("class").alias("y")))
    groups = components(links)

    def divided(left: DataFrame) -> DataFrame:
        """What is left of buckets that hold several components, with each row's and the bucket's largest one."""
        left = left.join(groups, left["class"] == groups["node"], "left").select("bucket", "class", "n", "rest", F.coalesce("component", "class").alias("component"))
        parts = left.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        largest = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("most.component").alias("main"))
        return staged(left.join(largest, "bucket"), "dedup-left")

    # the other bands' stars, from a member of the largest component to members of others
    left = divided(members)
    pivots = left.where("component = main").groupBy("bucket").agg(central)
    starred = left.where("component <> main").join(pivots, "bucket").where(reach("p.n", "p.rest"))
    found = confirmed(starred.select(F.least("class", "p.class").alias("x"), F.greatest("class", "p.class").alias("y")))
    if found.limit(1).count():
        links = staged(links.union(found), "dedup-links")
        groups = components(links)
    left = left.select("bucket", "class", "n", "rest")
    bits = sets.select("class", "bits", "least").join(classes.select("class", "bands"), "class")
    turns = min(EARLY, PIVOTS)
    while True:
        left = divided(left)
        if left.limit(1).count() == 0:
            break
        outside = Window.partitionBy("bucket").orderBy(F.col("n") - F.col("rest"), "class")
        pivots = left.where("component <> main").withColumn("turn", F.row_number().over(outside)).where(F.col("turn") <= turns)
        pivots = staged(pivots.join(bits, "class").select("bucket", F.col("bits").alias("pivot_bits"), F.col("least").alias("pivot_least"), F.col("bands").alias("pivot_bands"), F.col("class").alias("pivot"), F.col("n").alias("pivot_n"), F.col("rest").alias("pivot_rest"), F.col("component").alias("pivot_component")), "dedup-pivots")
        marked = left.join(pivots.select("bucket", F.col("pivot").alias("class"), F.lit(True).alias("is_pivot")), ["bucket", "class"], "left")
        pairs = marked.join(bits, "class").join(pivots, "bucket").where("component <> pivot_component and (is_pivot is null or class < pivot) and " + reach("pivot_n", "pivot_rest") + " and " + agree("bits", "pivot_bits") + " and array_intersect(pivot_bands, bands)[0] = bucket and " + similar("least", "pivot_least", percent))
        found = confirmed(pairs.select(F.least("class", "pivot").alias("x"), F.greatest("class", "pivot").alias("y")))
        if found.limit(1).count():
            links = staged(links.union(found), "dedup-links")
            groups = components(links)
        left, turns = marked.where("is_pivot is null").select("bucket", "class", "n", "rest"), PIVOTS

    named = classes.select("class", "set_name", "first_id").join(groups, F.col("class") == F.col("node"), "left").select("set_name", "first_id", F.coalesce("component", "class").alias("component"))
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(first, "component").select("set_name", "component_id", "component")
    out = described.select("doc_id", "text_key", "n_shingles", "set_name").join(named, "set_name", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component", "text_key")


def one_of_each(found: DataFrame) -> DataFrame:
    """(doc_id, text_key) of one row of each component, of the smallest id, and of all rows with empty sets. Minima are made before rows
    are dealt out, so that a large group costs no task more."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("_r")
    grouped = found.where("component is not null").groupBy("component").agg(least).select("_r.doc_id", "_r.text_key")
    return grouped.unionByName(found.where("component is null").select("doc_id", "text_key")).distinct()
