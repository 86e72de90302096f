"""Corpus pipeline: reject toxic documents, keep one of each group of near-duplicates, cut repeated passages, pack.

Each stage takes what the one before kept. All but the last return the columns of ``documents``; the last returns the
packed pieces. Rows without doc_id stay; extra columns pass through the first three stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import neardup, packing, suffixes, toxicity
from civicspark.llm.common import fresh, read, written

REJECT = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels of documents not held out, is below REJECT."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = fresh("score", docs.columns)
    return toxicity.score(docs, model, docs.columns, score).where(F.col(score) < REJECT).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8."""
    dropped = fresh("dropped", docs.columns)
    copies = neardup.labelled(docs).where("NOT kept").select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(dropped), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier; n_chars is counted anew."""
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained classifier, whole-corpus components and byte runs: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
