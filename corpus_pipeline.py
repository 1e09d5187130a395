"""A corpus pipeline of five stages over documents: quality rules, classifier, near duplicates, secrets, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever these are called. Null texts count as empty:
they fail the first stage. Rows with equal texts are judged alike; of equal rows, and of near duplicates, one stays. An
empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import classifier, jaccard, packing, repetition, secrets
from tallyloom.llm.common import removed, tidied, written
from tallyloom.llm.queries import byte_bpe, read


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.kept_documents(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return classifier.kept_documents(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    return jaccard.representatives(docs, words=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each found secret replaced by a mark."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    pieces = packing.pack(docs, byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", by_rules),
    ("quality classifier", by_classifier),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Tokenisation and a fitted model have no SQL form: tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with tidied(spark) as kept:
            before = docs
            docs = written(stage(spark, before, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        if hasattr(before, "scratch"):
            removed(spark, before.scratch)
    return STAGES[-1][1](spark, docs, sf_dir)
