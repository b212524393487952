"""Corpus pipeline over `documents`: language ID, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import stages
from offerlens.llm.frames import table, written

#: SQL cannot express the text model of language ID, the similarity of all pairs or the encoding.
ORACLE_SQL = None

STAGES = [
    ("language_id", stages.language),
    ("line_dedup", stages.lines),
    ("simhash_near_dedup", stages.near_duplicates),
    ("decontamination", stages.benchmark),
    ("sentencepiece", stages.encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
