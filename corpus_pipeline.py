"""A corpus from documents to packed sequences: classify, apply rules, drop near-duplicates, mix sources, pack.

Every stage takes all that the one before kept. Rows with a null doc_id pass the
filters; null and empty texts are judged as empty, so the rules drop those with an
id; rows that repeat a doc_id are judged together and become one at near_dedup;
other columns go through unchanged, whatever their names. No documents: no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pressloom.llm import mixing, neardup, packing, quality, rules
from pressloom.llm.shared import settle


def _classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels table, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every rule of the ledger's policy."""
    return rules.keep_passing(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's weight draws them, from none to several times."""
    return mixing.mixed(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row, with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", _classify), ("quality_rules", _rules), ("near_dedup", _near_dedup), ("mixing", _mix), ("packing", _pack)]

#: Training, hashing and bin completion can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each but the last written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
