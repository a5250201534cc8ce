"""Triangles of a growing edge flow: each batch makes only those anew that have an edge it touched.

State is two tables in folders by batch number. ``edges``: the pairs that a batch touched with their sums after it. ``triangles``: the triangles that hold such a pair, with their
residual after it. The present state is the last row of each key. A batch reads only folders of earlier batches and replaces its own, so that a batch that is
delivered again changes nothing. ``compact`` folds all batches so far into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.operators.cycles import triplet_residual

SUMS = ["support", "weighted_margin", "n_obs"]


def _last(df: DataFrame, key: list[str]) -> DataFrame:
    """The row of the largest batch of each key."""
    rest = [c for c in df.columns if c not in (*key, "batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")


def _stored(spark: SparkSession, root: str, name: str, schema, before: int | None) -> DataFrame:
    """Rows of the batches before a number (all without one); empty before any was written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema.add("batch", "long"))
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{root}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def _copy(schema):
    return type(schema).fromJson(schema.jsonValue())


class TriangleState:
    """Edge sums and triangle residuals of a stream of observations (keys, i, j, sign, weight) in a folder."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], min_support: float = 0.0):
        self.spark, self.root, self.keys, self.least = spark, root, list(keys), min_support

    def edges(self, like, before: int | None = None) -> DataFrame:
        return _last(_stored(self.spark, self.root, "edges", _copy(like), before), [*self.keys, "i", "j"])

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of observations in. For foreachBatch."""
        w, s = F.col("weight"), F.col("sign")
        key = [*self.keys, "i", "j"]
        delta = batch.groupBy(*key).agg(F.sum("weight").cast("double").alias("support"), F.sum(w * s).cast("double").alias("weighted_margin"), F.count("*").alias("n_obs"))
        before = self.edges(delta.schema, number)
        touched = delta.join(before.select(*key, *[F.col(c).alias(f"_{c}") for c in SUMS]), key, "left")
        touched = touched.select(*key, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS])
        self._write(touched, "edges", number)
        schema = _copy(delta.schema)
        touched = self.spark.read.schema(schema).parquet(f"{self.root}/edges/batch={number}")
        now = self.edges(delta.schema, number + 1).withColumn("margin", F.col("weighted_margin") / F.col("support"))
        # edges of triangles with a touched edge: those that share a node with it; triangles without one drop out by the last join
        near = touched.select(*self.keys, F.explode(F.array("i", "j")).alias("_n")).distinct()
        around = now.join(near.withColumnRenamed("_n", "i"), [*self.keys, "i"], "left_semi").unionByName(now.join(near.withColumnRenamed("_n", "j"), [*self.keys, "j"], "left_semi")).distinct()
        tri = triplet_residual(around, self.keys, self.least)
        arcs = lambda a, b: touched.select(*self.keys, F.col("i").alias(a), F.col("j").alias(b), F.lit(True).alias(f"_{a}{b}"))
        for a, b in (("i", "j"), ("j", "k"), ("i", "k")):
            tri = tri.join(arcs(a, b), [*self.keys, a, b], "left")
        made = tri.where("_ij or _jk or _ik").select(*self.keys, "i", "j", "k", "residual_energy", "total_energy", "rho", "cyclic")
        self._write(made, "triangles", number)

    def triangles(self) -> DataFrame:
        """(keys, i, j, k, residual_energy, total_energy, rho, cyclic) of all triangles so far."""
        types = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.root}/edges").schema}
        fields = ", ".join([f"`{c}` {types[c]}" for c in [*self.keys, "i", "j"]] + [f"k {types['i']}", "residual_energy double", "total_energy double", "rho double", "cyclic boolean"])
        return _last(_stored(self.spark, self.root, "triangles", self.spark.createDataFrame([], fields).schema, None), [*self.keys, "i", "j", "k"])

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")

    def compact(self, into: str, upto: int) -> TriangleState:
        """The state after batch ``upto`` as one batch of that number in a new folder, where later batches go on."""
        new = TriangleState(self.spark, into, self.keys, self.least)
        edges = self.spark.read.parquet(f"{self.root}/edges").where(F.col("batch") <= upto)
        new._write(_last(edges, [*self.keys, "i", "j"]), "edges", upto)
        triangles = self.spark.read.parquet(f"{self.root}/triangles").where(F.col("batch") <= upto)
        new._write(_last(triangles, [*self.keys, "i", "j", "k"]), "triangles", upto)
        return new
