"""A scope's graph as one row of arrays, and kernels over such rows by Arrow batches.

A scope's alternatives are few by nature (models, or the answers to one prompt): a row holds one graph, never a table. Any number of scopes runs in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graphs(edges: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, nodes (sorted names), a, b (positions of i and j), and an array for each of ``values``; edges in the order of (i, j)."""
    rows = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", *[F.col(v).cast("double").alias(v) for v in values]))).alias("_e"))
    rows = rows.withColumn("nodes", F.array_sort(F.array_distinct(F.concat("_e.i", "_e.j"))))
    at = lambda side: F.transform(F.col(f"_e.{side}"), lambda x: (F.array_position("nodes", x) - 1).cast("int"))
    return rows.select(*keys, "nodes", at("i").alias("a"), at("j").alias("b"), *[F.col(f"_e.{v}").alias(v) for v in values])


def each(rows: DataFrame, keep: list[str], fields: str, kernel: Callable[..., dict]) -> DataFrame:
    """``keep`` and the fields of ``kernel``'s results: a row for each row, or for each entry if the kernel gives lists under "_rows".

    ``kernel`` gets the row's other columns as numpy arrays or plain values; ``fields``: its result's schema.
    """
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    given = [c for c in rows.columns if c not in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema], fields])
    kinds = [f.dataType for f in rows.sparkSession.createDataFrame([], fields).schema]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(k) for k in kinds]

    def value(column: pa.Array, k: int):
        v = column[k]
        return v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) and v.is_valid and not pa.types.is_string(v.type.value_type) else v.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = {n: [] for n in names}, []
            for k in range(batch.num_rows):
                got = kernel(**{c: value(batch.column(c), k) for c in given})
                many = got.pop("_rows", None)
                for n in names:
                    found[n].extend(got[n] if many else [got[n]])
                owner.extend([k] * (len(got[names[0]]) if many else 1))
            kept = [batch.column(c).take(pa.array(owner, pa.int64())) for c in keep]
            plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([plain(v) for v in found[n]], t) for n, t in zip(names, types, strict=True)]], [*keep, *names])

    return rows.mapInArrow(run, schema)


def incidence(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """A row an edge: 1 at its first node, -1 at its second."""
    out = np.zeros((len(a), n))
    rows = np.arange(len(a))
    np.add.at(out, (rows, a), 1.0)
    np.add.at(out, (rows, b), -1.0)
    return out


def solver(edges: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The pseudo-inverse of the weighted Laplacian times the weighted incidence: margins to scores of mean 0 (of each part of the graph)."""
    return np.linalg.pinv(edges.T @ (w[:, None] * edges), hermitian=True) @ (edges.T * w)
