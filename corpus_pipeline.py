"""A corpus pipeline of five stages: each takes all that the one before kept.

language (texts without a letter go, missing labels are filled), near duplicates (one document of each group
stays), decontamination (contaminated documents go), secrets (spans are replaced),
tokens (ids of every text, and a digest of the decoded text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, decontaminate, jaccard, language, secrets
from geoloom.llm.common import table
from geoloom.llm.entries import vocabulary
from geoloom.operators.staging import drop_stages, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, empty ones and null ones go; a missing ``lang`` becomes the predicted one.

    Rows that repeat are judged alike; without any labelled row ``lang`` stays as it is.
    All columns of ``docs`` are kept, whatever their names; an empty table stays empty.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.75 or more) the smallest ``doc_id`` stays, unchanged.

    Rows that repeat one id are one document and stay together; rows with a null id are
    never compared and stay. All columns are kept; an empty table stays empty.
    """
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows over one word in twenty or more go; all others stay, unchanged.

    Rows that repeat are judged alike. Items without text or words are never found, items
    without an id are. All columns are kept; an empty table of documents or items is fine.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in ``text`` are replaced by a mark, and ``n_chars`` follows.

    Null texts stay null. All other columns are kept; an empty table stays empty.
    """
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but ``text``, with n_tokens, ids (of the whole text) and a digest of the decoded text.

    A null text counts as empty. Columns of ``docs`` that bear a result's name are replaced.
    """
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    whole = docs.select(*own, F.coalesce("text", F.lit("")).alias("text"))
    return bpe.round_trip(whole, vocabulary("byte_bpe_50k.json")).select(*own, "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]
#: Language models, links and BPE are beyond SQL: a test holds run() against the brute-force forms of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again, then the one before is removed."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = stage(docs, f"stage-{name}")
            if folder:
                drop_stages(spark, folder)
            folder = path
    return docs
