"""Cells that hold lists and dicts as JSON or as Python literals, as JSON text."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that stand for no value (fixed values).
NULL_LIKE = ("", "none", "null", "nan")


def _plain(x):
    """``x`` with tuples as lists and keys as text; an error for what JSON can't hold."""
    if isinstance(x, dict):
        return {k if isinstance(k, str) else json.dumps(_plain(k)): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise ValueError(f"no JSON for {type(x).__name__}")


def to_json_text(cell: str | None) -> str | None:
    """The JSON of a cell that is a list or dict in JSON or in Python's spelling; null for null-like text and for anything else."""
    if cell is None or cell.strip().lower() in NULL_LIKE:
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(cell.strip())
            if isinstance(value, (list, tuple, dict)):
                return json.dumps(_plain(value), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def with_json(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the column's cells as JSON text. Cells that are lists or dicts of JSON stay in the JVM; Python reads the others, by Arrow batches."""
    cell = F.col(column)
    json_ok = F.try_parse_json(cell).isNotNull() & F.trim(cell).rlike(r"^[\[{]") if hasattr(F, "try_parse_json") else F.lit(False)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [c if fine else to_json_text(c) for c, fine in zip(batch.column(column).to_pylist(), batch.column("_fine").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, name])

    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.withColumn("_fine", F.coalesce(json_ok, F.lit(False))).mapInArrow(run, f"{fields}, `{name}` string")
