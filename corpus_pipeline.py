"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from interlace.llm import mixing, nearcopies, packing, quality, suffixes
from interlace.llm.common import materialise, table

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_dedup", nearcopies.stage),
    ("suffix_dedup", suffixes.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has no XXH64, suffix arrays, classifier or tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None
