"""The corpus pipeline: quality rules, near copies, personal data, mixture, packing.

Each stage is (name, function of session, documents and table folder); its result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import stage_table, table
from tidewatch.llm.minhash import dedup_stage
from tidewatch.llm.mixing import mixing_stage
from tidewatch.llm.packing import pack_stage
from tidewatch.llm.pii import pii_stage
from tidewatch.llm.quality import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near copies", dedup_stage),
    ("personal data", pii_stage),
    ("mixture", mixing_stage),
    ("packing", pack_stage),
]

# Signatures, the trained model and token ids are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = stage_table(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
