"""From raw documents to token ids in five stages; each works on all the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import bpe, mixing, pii, quality, simhash
from veilframe.llm.common import checkpoint, forget, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.dedup(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced, by the key of the setting pii.KEY_SETTING."""
    return pii.clean(docs, pii.key_of(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the checksum of what they decode to."""
    return bpe.tokenised(docs, *bpe.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii_surrogates", pii_surrogates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Shingle sets, surrogates and token ids have no SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's documents are deleted once the next one's are written,
    so texts with personal data stand in the checkpoint folder only while they are needed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:  # stages read their input more than once
            docs = checkpoint(docs, wide=True)
            if before is not None:
                forget(before)
            before = docs
    return docs
