"""Ranked lexical search: the best documents of each item, by dense products of item tiles and document tiles.

Terms are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. One pass over the documents counts their terms and
keeps those that an item has, as numbers in the items' vocabulary; the sums N, L and df come from what it wrote. In a second pass each task
takes ``DOCS`` documents at a time: their impacts become a dense float64 tile over the compact vocabulary of a tile of items
(at most ``TERMS`` terms, cut further where a product could pass 2**53), which BLAS multiplies by the items' weights. All factors are integers and
all partial sums stay below 2**53, so that the products are exact in any order of summation. Of each product only documents that reach an
item's k-th best so far go on; ties are settled by doc_id. A task emits k rows an item, which two windows merge: within groups of tasks, then overall.

Items are dealt with in groups of about ``GROUP`` (item, term) pairs, each with passes of its own over the documents, so that what tasks get of the
items has a proven size; one group is enough for thousands of items.

Edge cases: null and empty texts have no terms: such documents are in no result, such items have none; rows that share an item_id (null ids too)
are one item with all their terms; repeated documents are documents of their own; of equal scores the smaller doc_id comes first, null last; fewer than k
documents with a score above 0 give fewer rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefgraph.llm.common import ship_package, staged, tidy, utf8

DOCS, ITEMS, TERMS, GROUP = 512, 256, 4096, 1 << 18
#: Weights are in thousandths, impacts in millionths: both are integers.
SCALE, IMPACT = 1000, 1_000_000
#: ASCII letters, digits and all bytes beyond ASCII belong to terms; other bytes part them.
_TABLE = bytes(c if c > 127 or chr(c) in string.ascii_letters + string.digits else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """All terms of a text in UTF-8."""
    return utf8(text).translate(_TABLE).split()


def weight(df: int, n_docs: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def _postings(vocabulary):
    """A row a document: its number of terms and the known terms with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            n, ids, tfs, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = terms(text)
                n.append(len(words))
                for word, tf in Counter(words).items():
                    k = number.get(word)
                    if k is not None:
                        ids.append(k)
                        tfs.append(tf)
                ends.append(len(ids))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    return tidy(run)


def _frequencies(size: int):
    """Documents a term of this task's rows, terms without any left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["term", "df"])

    return run


class Tile:
    """Some items: their terms' compact vocabulary in chunks, and the weights of each chunk as a matrix."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        vocabulary = np.unique(np.concatenate(items))
        most = int(weights[vocabulary].max(initial=1)) * IMPACT
        step = max(1, min(TERMS, (2**53 - 1) // max(most, 1)))
        self.items, self.chunks = len(items), []
        for a in range(0, len(vocabulary), step):
            part = vocabulary[a : a + step]
            matrix = np.zeros((len(part), len(items)))
            for k, ids in enumerate(items):
                here = ids[(ids >= part[0]) & (ids <= part[-1])]
                matrix[np.searchsorted(part, here), k] = weights[here]
            self.chunks.append((part, matrix))

    def scores(self, docs: int, owner: np.ndarray, ids: np.ndarray, impact: np.ndarray, place: np.ndarray) -> np.ndarray:
        """int64 scores, a row a document. ``place``: room for a number for each term."""
        out = np.zeros((docs, self.items), np.int64)
        for part, matrix in self.chunks:
            place[part] = np.arange(len(part))
            at = place[ids]
            here = at >= 0
            dense = np.zeros((docs, len(part)))
            dense[owner[here], at[here]] = impact[here]
            out += (dense @ matrix).astype(np.int64)
            place[part] = -1
        return out


def tiles(items: list[np.ndarray], weights: np.ndarray, most_items: int = ITEMS, most_terms: int = TERMS) -> list[tuple[int, Tile]]:
    """(first item, tile) of consecutive items that have at most ``most_terms`` terms between them, or of one item."""
    out, start, seen = [], 0, set()
    for k, ids in enumerate(items):
        grown = seen.union(ids.tolist())
        if k > start and (k - start == most_items or len(grown) > most_terms):
            out.append((start, Tile(items[start:k], weights)))
            start, grown = k, set(ids.tolist())
        seen = grown
    if start < len(items):
        out.append((start, Tile(items[start:], weights)))
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Best:
    """The k best documents of each item so far."""

    def __init__(self, count: int, k: int):
        self.k, self.least = k, np.ones(count, np.int64)
        self.rows = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))] * count

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Takes a tile's scores; documents that tie with the k-th best are looked at too."""
        alive = scores >= self.least[first : first + scores.shape[1]]
        for c in np.flatnonzero(alive.any(axis=0)).tolist():
            found = np.flatnonzero(alive[:, c])
            have = self.rows[first + c]
            new = tuple(np.concatenate(pair) for pair in zip(have, (ids[found], null[found], scores[found, c]), strict=True))
            order = np.lexsort((new[0], new[1], -new[2]))[: self.k]
            self.rows[first + c] = tuple(x[order] for x in new)
            if len(order) == self.k:
                self.least[first + c] = new[2][order[-1]]


def _search(shared, n_docs: int, n_terms: int, k: int, docs_a_tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, weights = shared.value
        plan, best, place = tiles(items, weights), Best(len(items), k), np.full(len(weights), -1, np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, docs_a_tile):
                part = batch.slice(a, docs_a_tile)
                doc = part.column("doc_id")
                null = np.asarray(doc.is_null())
                doc_ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
                sizes = np.diff(part.column("ids").offsets.to_numpy())
                owner = np.repeat(np.arange(part.num_rows), sizes)
                ids, tf = part.column("ids").flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(np.int64)
                m = 50 + (50 * part.column("n").to_numpy() * n_docs) // max(n_terms, 1)
                impact = impacts(tf, m[owner])
                for first, tile in plan:
                    best.add(first, tile.scores(part.num_rows, owner, ids, impact, place), doc_ids, null)
        lens = [len(r[0]) for r in best.rows]
        if sum(lens):
            doc_ids, null, scores = (np.concatenate(c) for c in zip(*best.rows, strict=True))
            task = pa.array(np.full(len(doc_ids), TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items), dtype=np.int32), lens)), task, pa.array(doc_ids, mask=null), pa.array(scores)], ["item", "task", "doc_id", "score"])

    return tidy(run)


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _rank_group(docs: DataFrame, asked: DataFrame, k: int, docs_a_tile: int) -> DataFrame:
    spark = docs.sparkSession
    # about ``GROUP`` (item, term) pairs, or one item
    rows = sorted(((r["item_id"], r["terms"]) for r in asked.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    words = sorted({w for _, ws in rows for w in ws})
    number = {w: n for n, w in enumerate(words)}
    items = [np.array([number[w] for w in ws], np.int32) for _, ws in rows]
    vocabulary = spark.sparkContext.broadcast(number)
    postings = staged(docs.mapInArrow(_postings(vocabulary), "doc_id long, n long, ids array<int>, tfs array<int>"), "rank-postings")
    sums = postings.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # a row a term of the group
    df = postings.select("ids").mapInArrow(_frequencies(len(words)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.full(len(words), weight(0, sums["docs"]), np.int64)
    for r in df.collect():
        weights[r["term"]] = weight(r["df"], sums["docs"])
    shared = spark.sparkContext.broadcast((items, weights))
    found = postings.where("size(ids) > 0").mapInArrow(_search(shared, sums["docs"], sums["terms"], k, docs_a_tile), "item int, task int, doc_id long, score long")
    merged = _ranked(_ranked(found.withColumn("_g", F.col("task") % 64), ["item", "_g"], k), ["item"], k)
    # the group's item ids by number
    names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "item int, item_id long")
    return merged.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, *, k: int = 50, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", group: int = GROUP, docs_a_tile: int = DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_terms, "item_id long, terms array<binary>")
    asked = staged(asked.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms")), "rank-items")
    groups = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // group)
    dealt = [asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) for g in range(groups)]
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, [_rank_group(docs, part, k, docs_a_tile) for part in dealt]) if dealt else none
