"""The corpus pipeline: language ID, exact de-duplication, SimHash near-duplicates, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read again.

Edge cases: language ID drops null texts, texts without letters and those told with a score under 0.5; null ids and repeated rows
go through as rows of their own until exact de-duplication, which keeps one row of each text (the one with the largest id); of near
copies the smallest id stays, and rows without an id; texts of any length are read whole; a table without rows gives one without rows;
columns beside those of documents are kept up to the mix, whatever their names, and dropped by the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm import bpe, exact_dedup, language_id, mixing, simhash
from graphspark.llm.common import read_table, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix: a row for each document in a block, with its words there."""
    return mixing.take(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes).get("n_chars", "long")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids in place of the text, and their number."""
    ids = bpe.encode(docs.select("doc_id", "source", "lang", "text"), out="token_ids").drop("text")
    return ids.selectExpr("doc_id", "source", "lang", "token_ids", "cast(length(token_ids) / 4 AS bigint) AS n_tokens")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Language scores, XXH64 fingerprints and permutations have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
