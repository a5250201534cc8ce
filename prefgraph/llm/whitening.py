"""Whitening directions of embeddings: centred rows reduced by blockwise QR, bidiagonalised, solved by dqds and twisted factorisations.

Entries become integers x = floor(64 c) + 1000000, and the fit list holds each distinct x vector once. Its size n and the sums S per dimension are exact, so
each row is centred as (n x - S) / n from exact integers before anything is multiplied; the covariance itself is never formed. Tasks reduce their rows
block by block to one triangle, triangles are reduced ``FAN`` at a time until a few are left, and the last one (as many rows as dimensions) is
solved where the job is driven (``qd_svd``): small eigenvalues keep their relative accuracy, which squaring rows would halve. Directions (16 x dimensions) go out
with the second pass, which projects all rows; the covariance of the projected fit list is measured against the identity.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, also rows whose length isn't the most frequent one
among the rest (the longest of equally frequent); null ids stay; repeated rows count once in the fit list and all appear in the result; components
whose eigenvalue is 0 at double precision are left out, since nothing whitens them, so one distinct vector (or none) gives an empty result; deviations
beyond a long are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.common import ship_package, staged
from prefgraph.llm.qd_svd import right_singular

COMPONENTS, BLOCK, FAN = 16, 4096, 8
SCALE, SHIFT = 64, 1_000_000


def integers(vector: Column) -> Column:
    """The x vector; null where an entry is null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy()
    return flat.reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a dimension: this task's rows and their sum, as decimal text beyond any overflow."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch)
            part = x.sum(axis=0) if int(np.abs(x).max()) < 2**62 // len(x) else x.astype(object).sum(axis=0)
            n, total = n + len(x), part.astype(object) + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array([str(v) for v in total])})


class Centre:
    """n x - S, exactly, and (n x - S) / n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.exact = n, np.array(sums, object)
        self.wide = max(map(abs, sums), default=0) >= 2**61
        self.sums = None if self.wide else np.array(sums, np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.wide or (len(x) and int(np.abs(x).max()) >= 2**61 // self.n):
            return self.n * x.astype(object) - self.exact
        return self.n * x - self.sums

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        """Exact sums of squares; null beyond a long."""
        big = int(np.abs(centred).max()) if centred.size else 0
        if big * big * max(centred.shape[1], 1) < 2**63:
            return (centred * centred).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in (int(r @ r) for r in centred.astype(object))]


def _triangle(held: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if held is None else np.vstack([held, rows]), mode="r")


def _packed(held: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if held is not None:
        yield pa.RecordBatch.from_pydict({"height": pa.array([len(held)], pa.int32()), "r": pa.array([held.tobytes()], pa.binary())})


def _reduce_rows(centre: Centre):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                held = _triangle(held, centre(_rows(batch.slice(a, BLOCK))).astype(np.float64) / centre.n)
        yield from _packed(held)

    return run


def _reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for height, r in zip(batch.column("height").to_pylist(), batch.column("r").to_pylist(), strict=True):
            held = _triangle(held, np.frombuffer(r).reshape(height, -1))
    yield from _packed(held)


def _triangle_of(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of all centred rows; at most ``FAN`` triangles meet in one place."""
    schema = "height int, r binary"
    held = staged(fit.mapInArrow(_reduce_rows(centre), schema), "whitening-r")
    count = held.count()
    while count > FAN:
        held = staged(held.repartition(-(-count // FAN)).mapInArrow(_reduce_triangles, schema), "whitening-r")
        count = held.count()
    last = None
    for row in held.collect():  # at most FAN triangles
        last = _triangle(last, np.frombuffer(row["r"]).reshape(row["height"], -1))
    wide = last.shape[1]
    return np.vstack([last, np.zeros((wide - len(last), wide))]) if len(last) < wide else last


def _moments(centre: Centre, directions: np.ndarray):
    """Sums of whitened values and of their products over this task's rows of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((directions.shape[1] + 1,) * 2)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                w = centre(_rows(batch.slice(a, BLOCK))).astype(np.float64) / centre.n @ directions
                w = np.column_stack([w, np.ones(len(w))])
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": pa.array(total.ravel())})

    return run


def _project(centre: Centre, directions: np.ndarray, explained: np.ndarray, error: float, names: list[str]):
    k = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                rows = part.num_rows
                centred = centre(_rows(part))
                whitened = centred.astype(np.float64) / centre.n @ directions
                each = np.repeat(np.arange(rows), k)
                deviation = pa.array(centre.deviation(centred), pa.int64())
                columns = [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, centre.n)), deviation.take(pa.array(each)), pa.array(whitened.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("x")).where("x is not null")
    rows = staged(rows, "whitening-rows")
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == length["length"])
    fit = staged(rows.select("x").distinct(), "whitening-fit")
    # a row a dimension
    sums = fit.mapInArrow(_sums, "dim int, n long, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    centre = Centre(sums[0]["n"], [int(r["s"]) for r in sums])
    r = _triangle_of(fit, centre)
    squares, vectors_ = right_singular(r, components)
    if not len(squares):
        return spark.createDataFrame([], schema)
    directions = vectors_ / np.sqrt(squares / centre.n)
    explained = squares / (r * r).sum()
    moments = fit.mapInArrow(_moments(centre, directions), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    k = len(squares)
    total = np.zeros((k + 1, k + 1))
    for m in moments:  # 17 x 17 at most
        total[m["i"], m["j"]] = m["s"]
    mean = total[:k, k] / centre.n
    error = float(np.abs(total[:k, :k] / centre.n - np.outer(mean, mean) - np.eye(k)).max())
    return rows.mapInArrow(_project(centre, directions, explained, error, [f.split()[0] for f in schema.split(", ")]), schema)
