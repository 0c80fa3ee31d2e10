"""A corpus pipeline of five stages; each works on all that the one before it kept.

1. toxicity: documents that the classifier rejects go.
2. line dedup: repeated passages go from all texts but the first that has them.
3. near duplicates: one document of each group stays (five-word shingles, similarity 0.8).
4. decontamination: benchmark passages are cut from the texts.
5. packing: the documents become sequences of at most 4096 tokens.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import discard, stage, table
from gridloom.llm.decontamination import decontaminate
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.near_dup import keep_one
from gridloom.llm.packing import pack
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.toxicity import fit, score

REJECTED_FROM = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of a score of REJECTED_FROM or more; null and empty texts are scored as empty."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    found = score(docs, fit(docs, labels), "gridloom_score")
    return found.where(F.col("gridloom_score") < REJECTED_FROM).drop("gridloom_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL can't express the classifier's training; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
