"""The corpus pipeline: each stage is one operator of ``medwright.llm``, applied to what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medwright.llm import stages
from medwright.llm.common import release, table, written

STAGES = [
    ("toxicity", stages.toxicity_stage),
    ("exact_dedup", stages.exact_dedup_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("packing", stages.packing_stage),
]

#: SQL cannot express the learned filter, the signatures or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        release(spark, before)
    return docs
