"""The corpus pipeline: documents pass the stages in order; each stage's rows are
written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraudlens.llm import stages
from fraudlens.llm._tables import documents, materialize, ship


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage on five words: texts that differ in scattered words are no copies."""
    return stages.near_dedup(spark, docs, sf_dir, shingle=5)


STAGES = [
    ("language_id", stages.language_id),  # 6: PPM; documents that it rejects go
    ("near_dedup", near_dedup),  # 3: MinHash join on five words; one document of each class stays
    ("substring_dedup", stages.substring_dedup),  # 5: suffix trees; repeated passages go
    ("source_mix", stages.source_mix),  # 8: sources to target weights
    ("tokens", stages.tokens),  # 10: BPE with a segment tree
]

#: Language models and byte-pair merges have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the table ``documents``; the last one's rows."""
    ship(spark)
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
