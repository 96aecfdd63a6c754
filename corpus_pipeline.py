"""Corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept.  ``run`` writes what a stage returns to shared storage and reads it again
as the next one's input.  SQL cannot express language ID, decontamination and
BPE, so ``ORACLE_SQL`` is None; tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandstream.llm import bpe, decontaminate, language, linededup, simhash
from bandstream.llm.common import prepare, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go (operator 4)."""
    return language.stage(prepare(spark), docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, the first of each stays (operator 3)."""
    return linededup.stage(prepare(spark), docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 6, then min-wise keys)."""
    return simhash.stage(prepare(spark), docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go (operator 1)."""
    return decontaminate.stage(prepare(spark), docs, sf_dir)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts (operator 9)."""
    return bpe.stage(prepare(spark), docs, sf_dir)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
