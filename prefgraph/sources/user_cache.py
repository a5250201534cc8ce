"""Users' preference table kept between runs: partial sums for each load of files, and a manifest of the files that are in.

A run lists the input, reads only files that no load has yet, and writes their partial sums as a load of its own; the table is the sum over loads, written by country. Sums,
counts and the first row's country are mergeable, so the result is that of a run over everything. A file that is gone or has changed makes all loads void: then everything is read again.
A load counts only once its manifest is there, which is written last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.functions.labels import safe_name

MANIFEST = "path string, length long, changed timestamp, load string"


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, changed) of the input's files; their content isn't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.col("modificationTime").alias("changed"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def partial_sums(rows: DataFrame) -> DataFrame:
    """(user_id, alternative, total, saved, first): mergeable; alternative is null in the row that holds a user's saved rows and first country."""
    sums = rows.groupBy("user_id", "alternative").agg(F.sum(F.when(F.col("saved") == 1, F.col("cnt")).otherwise(-F.col("cnt"))).alias("total"))
    users = rows.groupBy("user_id").agg(F.sum("saved").cast("long").alias("saved"), F.min(F.struct("row_key", "country")).alias("first"))
    none = lambda c: F.lit(None).cast(users.schema[c].dataType).alias(c)
    return sums.select("user_id", "alternative", "total", none("saved"), none("first")).unionByName(users.select("user_id", F.lit(None).cast("string").alias("alternative"), F.lit(None).cast(sums.schema["total"].dataType).alias("total"), "saved", "first"))


def merged(parts: DataFrame, min_scenarios: int) -> DataFrame:
    """(user_id, country, alternative, n_scenarios, beta) of users with enough saved rows."""
    users = parts.where("alternative is null").groupBy("user_id").agg(F.sum("saved").alias("n_scenarios"), F.min("first").alias("_f")).where(F.col("n_scenarios") >= min_scenarios)
    sums = parts.where("alternative is not null").groupBy("user_id", "alternative").agg(F.sum("total").alias("_t"))
    return sums.join(users, "user_id").select("user_id", F.col("_f.country").alias("country"), "alternative", "n_scenarios", (F.col("_t") / F.col("n_scenarios")).alias("beta"))


def refresh(spark: SparkSession, pattern: str, root: str, min_scenarios: int) -> tuple[DataFrame, int]:
    """The user table over all files of the pattern, by country, and how many files this run read."""
    now = listed(spark, pattern)
    known = spark.read.schema(MANIFEST).parquet(f"{root}/manifest") if _there(spark, f"{root}/manifest") else spark.createDataFrame([], MANIFEST)
    same = known.join(now, ["path", "length", "changed"], "left_semi")
    if known.count() != same.count():
        known = known.limit(0)
        root_parts = f"{root}/parts-{uuid.uuid4().hex}"
    else:
        first = known.select("load").limit(1).collect()
        root_parts = first[0]["load"].rsplit("/", 1)[0] if first else f"{root}/parts-{uuid.uuid4().hex}"
    new = now.join(known.select("path"), "path", "left_anti")
    paths = [r["path"] for r in new.select("path").orderBy("path").collect()]  # names of the files of one run
    load = f"{root_parts}/load={uuid.uuid4().hex}"
    if paths:
        partial_sums(spark.read.parquet(*paths)).write.parquet(load)
        manifest = known.unionByName(new.withColumn("load", F.lit(load)))
        rows = manifest.collect()  # a row a file
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
        loads = sorted({r["load"] for r in rows})
        merged(spark.read.parquet(*loads), min_scenarios).withColumn("part", safe_name(F.coalesce(F.nullif("country", F.lit("")), F.lit("-")))).write.mode("overwrite").partitionBy("part").parquet(f"{root}/users")
    return spark.read.parquet(f"{root}/users").drop("part"), len(paths)
