"""Cleaning a corpus: five stages, each written as Parquet and read again as the next one's documents.

Each stage works on all that its predecessor kept, and its decisions take effect: rejected documents go, lines
go, of each group of near-duplicates one document stays; the last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.language import keep_known
from tidemark.llm.line_dedup import dedup_stage
from tidemark.llm.packing import pack_stage
from tidemark.llm.quality import keep_good
from tidemark.llm.similar import keep_one_of_similar
from tidemark.session import drop_folder, freed_shuffles, materialize, scratch

STAGES = [
    ("quality", keep_good),
    ("language", keep_known),
    ("line_dedup", dedup_stage),
    ("near_dedup", keep_one_of_similar),
    ("packing", pack_stage),
]

#: The classifiers and the packing search cannot be said in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows lie in the shared folder, a stage's other files go when it is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept, freed_shuffles(spark):
            docs, uri = materialize(stage(spark, docs, sf_dir), name)
            kept.append(uri)
        if before is not None:
            drop_folder(spark, before)
        before = uri
    return STAGES[-1][1](spark, docs, sf_dir)
