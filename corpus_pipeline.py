"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents that hold benchmark
passages go, and what is left is mixed by source. Each stage's rows are written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, minhash, mixing, toxicity
from tidemark.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: The classifier and the signatures can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
