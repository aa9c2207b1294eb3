"""One query for each operator, over its whole table, with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, byte_bpe, chat, decontaminate, filter_audit, jaccard, language, licenses, merkle, secrets, token_store, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_report(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotation_report(table(spark, sf_dir, "conversations"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_report(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_licenses, op3_bpe, op4_token_store, op5_language,
        op6_decontaminate, op7_chat, op8_jaccard, op9_audio, op10_toxicity, op11_merkle, op12_filter_audit, op13_byte_bpe,
    )
}
SQL = {"op1_secrets": secrets.SQL, "op7_chat": chat.SQL, "op11_merkle": merkle.SQL, "op12_filter_audit": filter_audit.SQL}
