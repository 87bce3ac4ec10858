"""A corpus pipeline of five stages: quality rules, near-dedup, benchmark decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame; all
but the last return the columns of docs. run() writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm import bpe, common, decontam, pii, quality, similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's rate reject go."""
    rows = common.boxed(docs, F.col("text"), F.col("source"))
    return common.unboxed(quality.judge(rows, text=False).where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of five-word shingles of 0.8 or more) stays."""
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; every document stays."""
    return pii.mask(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids."""
    return bpe.encode(docs, into="token_ids").withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]

#: Similar sets, checksummed spans and byte-level merges are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs, name.replace(" ", "-"))
    return docs
