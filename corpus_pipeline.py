"""A corpus pipeline of five stages over documents; each is written as Parquet and read again as the next one's input.

Language ID rejects documents of no known language, near-dedup keeps one document of each group, decontamination removes documents that
hold a benchmark item, the mix takes documents to the sources' targets (repeating epochs, cutting the last document), and
sharding places what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import op1_minhash, op2_mix, op4_decontaminate, op6_language, op8_shard
from trellis.llm.common import dropped, keep, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_minhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_mix.mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_shard.shard(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express language ID; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None
