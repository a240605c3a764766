"""From raw documents to packed sequences: five stages, each one of the operators of barloom.llm."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import mixing, packing, quality_rules, resampling, simhash
from barloom.llm.common import saved, table


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality_rules.kept_rows(docs, table(spark, sf_dir, "labels"))


def by_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the cut of importance resampling go."""
    kept = resampling.resample(docs, table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by the target weights of their sources, in random order."""
    return mixing.mix(docs, marks=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality_rules", by_quality_rules),
    ("quality_classifier", by_quality_classifier),
    ("near_duplicates", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# Learned rules, hashed n-gram models and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
