"""The queries of this subpackage: name -> function(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import token_digests

    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_media")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def _sharding_oracle() -> str:
    from .sharding import ORACLE

    return ORACLE


@query("op1_sharding", _sharding_oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"), "doc_id", "text")


def _url_oracle() -> str:
    from .url_filters import ORACLE

    return ORACLE


@query("op5_url_filters", _url_oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _warc_oracle() -> str:
    from .warc import ORACLE

    return ORACLE


@query("op3_warc", _warc_oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def _secret_oracle() -> str:
    from .secret_scan import ORACLE

    return ORACLE


@query("op13_secret_scan", _secret_oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling_variants import variants

    return variants(table(spark, sf_dir, "documents"))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import Tokenizers, alignment_digests

    return alignment_digests(table(spark, sf_dir, "documents"), Tokenizers(spark, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))
