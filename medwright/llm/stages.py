"""Stages of the corpus pipeline: an operator's decisions applied to documents, all columns kept.

Each stage works on all rows of its input. Columns that a stage adds on the way have names that no input
column has, so extra columns, whatever they are called, go through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medwright.llm import decontamination, near_dedup, toxicity
from medwright.llm.common import table
from medwright.llm.exact_dedup import exact_dedup, normalised_text
from medwright.llm.packing import pack


#: Words of each half of the encoder's memory in packing: it comes last, when the executors have grown by all other stages.
REMEMBERED = 100_000


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _no_wider(part: DataFrame, docs: DataFrame) -> DataFrame:
    """``part`` of ``docs`` in no more partitions than the stored ``docs`` is read in, however many a join deals it to."""
    return part.coalesce(max(part.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``toxicity.THRESHOLD`` or more go; null and empty texts score 0 and stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = _fresh(docs, "toxicity")
    return toxicity.score(docs, model, name, None).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    Rows are told apart by doc_id and text together, so an id that stands for two texts loses
    neither; a null doc_id cannot be named by the index and stays.
    """
    gone_id, gone_sha = _fresh(docs, "gone_id"), _fresh(docs, "gone_sha")
    gone = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    sha = F.sha2(normalised_text().cast("binary"), 256)
    return _no_wider(docs.join(gone.hint("merge"), (F.col("doc_id") == F.col(gone_id)) & (sha == F.col(gone_sha)), "left_anti"), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays; a null doc_id has no class and stays."""
    gone_id = _fresh(docs, "gone_id")
    gone = near_dedup.near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    return _no_wider(docs.join(gone.hint("merge"), F.col("doc_id") == F.col(gone_id), "left_anti"), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    name = _fresh(docs, "hits")
    return decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), name).filter(F.size(name) == 0).drop(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in the training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)
