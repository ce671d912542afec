"""The corpus pipeline: documents in, shards out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprep.llm import langid, mixing, neardup, sharding
from newsprep.llm import decontaminate as leak
from newsprep.llm.common import written
from newsprep.session import configure, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null text, or not one letter."""
    ship(configure(spark), "newsprep")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model[0]:  # nothing to learn from: every text with a letter is of the one language there is
        model = ["any"], np.zeros((1, langid.DIMENSIONS))
    return langid.predict(docs, model, into="_language").where("_language.lang_pred <> 'und'").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: four fifths of their shingles of five words in common.

    Documents without words, empty or null, are copies of nothing and stay; an empty table stays empty.
    """
    ship(configure(spark), "newsprep")
    return neardup.without_near_duplicates(docs, words=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; with no items, or in texts without words, nothing is held."""
    ship(configure(spark), "newsprep")
    found = leak.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="_found")
    return found.where("_found.n_hit = 0").select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says; null sources are a source of their own, texts without words cost nothing."""
    ship(configure(spark), "newsprep")
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals what is left into shards; null and empty texts are one byte each, and an empty table has no shard."""
    ship(configure(spark), "newsprep")
    return sharding.shard(docs)


STAGES = [
    ("language ID", language), ("near duplicates", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard),
]
#: Language ID has no SQL; the tests hold the operators against brute-force versions, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
