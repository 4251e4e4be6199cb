"""The corpus pipeline: documents in a known language, one of every near-duplicate group, masked, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm.common import cut, documents
from evidra.llm.op04_language import stage_language
from evidra.llm.op05_pii import stage_pii
from evidra.llm.op06_packing import stage_pack
from evidra.llm.op07_mixing import stage_mix
from evidra.llm.op10_dedup import stage_dedup

#: (name, function of (spark, docs, sf_dir)); each reads the Parquet that the one before has written.
STAGES = [
    ("language_id", stage_language),
    ("near_dedup", stage_dedup),
    ("pii", stage_pii),
    ("mixing", stage_mix),
    ("packing", stage_pack),
]

#: Learned classifiers, signatures and identifiers can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over the documents of sf_dir; each result is cut off in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
