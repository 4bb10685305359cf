"""Corpus pipeline: language ID, toxicity, near-duplicates, packing; each stage reads what the one before has written.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The first two
judge each row by its own text where it lies, so they shuffle nothing but what they learn from. Nulls in any column pass
through; a row with a null id is judged like any other; repeated rows share a near-duplicate class, of which one row stays;
extra columns are kept; an empty table stays empty (and packs into no piece).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import langid, neardup, packing, toxicity
from strataloom.llm.common import shared_folder, ship_code


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (null, no letter, or below the calibrated level) go. Where no row has a language, only those without a letter."""
    ship_code(spark)
    return langid.keep_identified(docs, langid.fit(docs, _remainder(3) != 1))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    ship_code(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, _remainder(4) != 2))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class one document stays, the one with the least id."""
    ship_code(spark)
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ship_code(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", deduplicate), ("packing", pack)]

#: SQL can't express the stages; tests/llm holds each stage's rows against a version of its own in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
