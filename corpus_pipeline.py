"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token store.

Each stage is a function (spark, docs, sf_dir) that works on everything its predecessor kept;
its result is written as Parquet and read back as the next one's documents. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from muniprop.llm import decontamination, quality_rules, simhash_dedup, source_mixing, token_store
from muniprop.llm.common import stage, stage_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade of quality rules."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id."""
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its source's budget takes it."""
    return source_mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mixture, read back from the written token store."""
    return token_store.read_documents(spark, token_store.write_store(docs, stage_path(spark, "pipeline-tokens")))


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_store", tokens),
]

# SimHash components and tokenizer output are not expressible in SQL; tests/llm compares run()
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
