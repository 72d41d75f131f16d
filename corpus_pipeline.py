"""A training-corpus pipeline: five operators, each on what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltarc.llm import bpe, decontaminate, near_dedup, pii, toxicity
from voltarc.llm.common import discard, settle, table
from voltarc.llm.queries import CATEGORIES, labels_of

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. NULL and empty texts are never rejected; repeated rows share their fate."""
    chain = toxicity.fit(docs, labels_of(spark, sf_dir), CATEGORIES)
    return toxicity.classify(docs, chain).where("not rejected").select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least id, NULL last, ties by a digest of the text. Texts
    without words stay; rows that repeat an id and its text stay once."""
    return near_dedup.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go; texts without words
    stay, as does everything where the benchmark is empty."""
    items = table(spark, sf_dir, "benchmark")
    return (decontaminate.contaminated(docs, items).where("not contaminated")
            .select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become marks; n_chars is the length of the new text."""
    return (pii.detect(docs).withColumn("text", F.col("pii_redacted"))
            .withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids that training reads, with their digests. A row per document, repeated rows
    included; a NULL or empty text has no tokens and decodes to the empty text; columns of the
    input other than doc_id go."""
    return (bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
            .select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_copies),
    ("decontaminate", remove_contaminated),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]

#: A trained classifier, near copies and a tokenizer are beyond SQL. Tests recompute each
#: stage from what the one before has kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
