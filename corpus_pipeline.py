"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing and sharding of `documents`.

Each stage works on all rows that the one before it kept, and each written result is the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.decontamination import contamination
from offerloom.llm.language import confident
from offerloom.llm.mixing import mix
from offerloom.llm.near_duplicates import keep_one
from offerloom.llm.sharding import interleave_shards
from offerloom.llm.shared import shared_table, table
from offerloom.session import ship

SHARDS = 40


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    return confident(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8 or more) stays."""
    return keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    rows = contamination(docs, table(spark, sf_dir, "benchmark"))
    return rows.where(~F.col("contaminated")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights."""
    return mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every shard has the mixture of the whole."""
    return interleave_shards(docs, SHARDS)


STAGES = [("language ID", recognised), ("near-duplicates", one_of_each), ("decontamination", uncontaminated), ("mixing", mixed), ("sharding", sharded)]
STAGES = [(name, lambda spark, docs, sf_dir, stage=stage: stage(ship(spark), docs, sf_dir)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, near-duplicates and decontamination have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None
