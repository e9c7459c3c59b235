"""From raw documents to token numbers: five stages, each written as Parquet and read again.

Rejected by the quality classifier: dropped. Near-duplicates (similarity 0.8 over five-word
shingles, by wide SimHash fingerprints): one of each group stays. Secrets:
masked in the text. Sources: mixed to their target weights, so documents may go or come twice.
Last, every text is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, fm, mixing, near_copies, secrets
from terrane.llm.registry import word_vocabulary
from terrane.llm.text import table
from terrane.session import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings = fm.Settings()
    return fm.good_documents(docs, fm.train(docs, table(spark, sf_dir, "labels"), settings), settings)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs, Workspace(spark, "near-duplicates"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, word_vocabulary(), columns=("doc_id", "source"), keep_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode),
]

# A learnt model and the tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is stored in the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
