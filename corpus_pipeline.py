"""A training-data pipeline over the documents table: each stage's Parquet output is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.llm import linededup, mixing, neardup, packing, quality
from casewright.llm.common import materialize, table

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", linededup.stage),
    ("near dedup", neardup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Tokenizing and random rounding have no SQL; tests hold every stage, in turn, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that pass, as packing.pack() gives them. Null, empty, repeated and very long texts, null ids and
    an empty table are as each stage states them; the columns of documents stay until the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
