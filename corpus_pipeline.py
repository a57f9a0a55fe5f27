"""A corpus pipeline from the operators of ``attestra.llm``: toxicity, line
dedup, near-duplicate dedup, benchmark decontamination, tokenising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import stored, table
from attestra.llm.decontaminate import decontaminate
from attestra.llm.line_dedup import without_common_blocks
from attestra.llm.near_dedup import one_per_class
from attestra.llm.queries import tokenizer_path
from attestra.llm.sentencepiece_codec import token_digests
from attestra.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are deleted."""
    return without_common_blocks(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of smallest id stays."""
    return one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text."""
    return token_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", tokens)]

#: The classifier, alignment and signatures have no SQL form; tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
