"""What the corpus operators share: the cluster's shared folder, written intermediates, the word pattern."""

from __future__ import annotations

import ctypes
import importlib
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Only in local mode, and where none is named (tests), a fresh local folder is set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not root:
        root = getattr(sc, "_prefgraph_shared", None)
        if root is None:
            root = sc._prefgraph_shared = "file://" + tempfile.mkdtemp(prefix="prefgraph-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/prefgraph/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, each row is computed once,
    and a lost executor costs only its unfinished tasks."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors that don't share the driver's source folder."""
    sc = spark.sparkContext
    if getattr(sc, "_prefgraph_shipped", False):
        return
    top = os.path.dirname(importlib.import_module("prefgraph").__file__)
    target = os.path.join(tempfile.mkdtemp(prefix="prefgraph-src-"), "prefgraph_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("prefgraph", os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._prefgraph_shipped = True


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """The batches of ``run``; then a task's freed memory goes back to the system, since its worker lives on beside the next stages."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def attempt_file(folder: str, suffix: str) -> str:
    """A file name for this attempt of this task; readers only see the files that successful attempts report."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


def open_output(uri: str):
    """A binary output stream in the shared folder, by the file system that the URI names."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable binary input in the shared folder."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
