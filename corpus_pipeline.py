"""A corpus from raw documents: toxic ones go, one of each group of near copies stays, sources are mixed, texts become pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
one's docs. All but the last keep the columns of docs, whatever their names, and give an empty result for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefgraph.llm import mixture, near_dedup, piece_bpe, toxicity
from prefgraph.llm.common import staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject. Null, empty and word-less texts score as clean ones, rows that repeat each other
    go or stay together, and rows without an id are scored by their text like others."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates at 0.8; of rows that repeat it, one.

    Rows are told apart by id and text, so that different texts under one id stay or go on their own. Null, empty and word-less texts are near
    nothing and stay; of a component without any id one row stays.
    """
    found = staged(near_dedup.near_duplicates(docs, percent=80), "pipeline-found")
    kept = near_dedup.one_of_each(found).toDF("_id", "_key")
    once = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_key"]), "left_semi")
    return once.dropDuplicates(["doc_id", "text"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them. Texts without words aren't taken; a null source is the last
    one, documents without a label weigh 1, and ``n_chars`` follows a text that is cut."""
    return mixture.apply_mix(docs, mixture.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the decoded text, a row for each row of the mix; a null or empty text has no ids."""
    return piece_bpe.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", without_toxic), ("near_dedup", without_copies), ("mixture", mixed), ("pieces", as_pieces)]

#: Toxicity and pieces can't be said in SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
