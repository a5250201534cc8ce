"""Permissive scans, schema resolution, shards and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, label: str) -> str:
    """A new path where the cluster keeps checkpoints. Only in local mode, and where none is named, one on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="prefgraph-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept_rows(rows: DataFrame, numbers: dict[str, str], condition: str = "true") -> DataFrame:
    """Text cells cast to numbers, bad ones null, with _valid: all numbers there and the condition met."""
    cast = rows.withColumns({c: F.col(c).try_cast(kind) for c, kind in numbers.items()})
    there = " and ".join(f"{c} is not null" for c in numbers) or "true"
    return cast.withColumn("_valid", F.coalesce(F.expr(f"({there}) and ({condition})"), F.lit(False)))


def scan_csv(spark: SparkSession, path: str, columns: list[str], numbers: dict[str, str], condition: str = "true") -> DataFrame:
    """Named columns of a CSV with header, dirty rows dropped. Only these columns are parsed; a single .gz can't be split, so it is spread."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path).select(*columns)
    if path.endswith(".gz"):
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return kept_rows(rows, numbers, condition).where("_valid").drop("_valid")


def field_paths(schema: StructType, depth: int = 2, within: str = "") -> list[str]:
    """Dotted paths of a schema's fields and of the fields of its structs, outer ones first."""
    inner = [(f.name, f.dataType) for f in schema if isinstance(f.dataType, StructType)]
    below = [p for name, kind in inner for p in field_paths(kind, depth - 1, f"{within}{name}.")] if depth > 1 else []
    return [within + f.name for f in schema] + below


def locate(schema: StructType, names: list[str], depth: int = 1) -> list[str]:
    """The fields that carry one of some names, in the names' order; equal spelling before equal letters, shallow before deep."""
    paths = field_paths(schema, depth)
    last = lambda p: p.rsplit(".", 1)[-1]
    return [p for n in names for p in ([p for p in paths if last(p) == n] or [p for p in paths if last(p).lower() == n.lower()])]


def required(schema: StructType, names: list[str], depth: int = 1) -> str:
    """The first field that carries one of some names; an error that lists the fields if there is none."""
    found = locate(schema, names, depth)
    if not found:
        raise ValueError(f"no field named {' or '.join(names)} among {', '.join(field_paths(schema, depth))}")
    return found[0]


#: Names under which published responses carry their model (fixed values).
MODEL_NAMES = ["model", "model_id", "model_name", "source", "generator", "name"]


def model_id(df: DataFrame, response: str, names: list[str] = MODEL_NAMES) -> Column:
    """Model of a response: the text itself, or the first filled field of a struct, one level down included; null if there is none."""
    kind = df.schema[response].dataType
    if not isinstance(kind, StructType):
        return F.nullif(F.trim(F.col(response).cast("string")), F.lit(""))
    leaves = [p for p in locate(kind, names, 2) if not isinstance(df.select(f"{response}.{p}").schema[0].dataType, StructType)]
    filled = [F.nullif(F.trim(F.col(f"{response}.{p}").cast("string")), F.lit("")) for p in leaves]
    return F.coalesce(*filled, F.lit(None).cast("string"))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Columns that are missing, as constants."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def placeholder_models(df: DataFrame, a: str, b: str):
    """Whether all model ids are mere roles (a, b, 0, 1, ...): then alternatives are responses. False without any id."""
    roles = ("a", "b", "model a", "model b", "model_a", "model_b", "response a", "response b", "0", "1")
    role = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin(*roles), F.lit(True))
    named = F.coalesce(F.max(F.col(a).isNotNull() | F.col(b).isNotNull()), F.lit(False))
    return df.agg((named & F.coalesce(F.bool_and(role(a) & role(b)), F.lit(False))).alias("placeholder"))


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """All CSV shards of a glob, columns matched by name and null where a shard lacks them, as text, with source_file.

    The driver reads each file's header line; files with equal headers are one scan. Files without a header line are left out.
    """
    files = [r["path"] for r in spark.read.format("binaryFile").load(pattern).select("path").collect()]
    alike: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(files):
        names = tuple(spark.read.option("header", True).csv(path).columns)
        if names:
            alike.setdefault(names, []).append(path)
    parts = [spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(paths).withColumn("source_file", F.col("_metadata.file_path")) for names, paths in alike.items()]
    if not parts:
        return spark.createDataFrame([], "source_file string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_scoped(df: DataFrame, path: str, scope: str, kind: str = "parquet") -> None:
    """One folder per scope."""
    df.write.partitionBy(scope).mode("overwrite").format(kind).save(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of a small result; an error for one of more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(lines)
