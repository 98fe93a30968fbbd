"""A corpus pipeline: quality, near-duplicates, secrets, mixture and tokens, in this order.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; between stages the
documents are written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, mixing, quality, secret_scan, simhash
from gridloom.plans.scratch import Scratch

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", simhash.stage),
    ("secrets", secret_scan.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: Models and iterations can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
