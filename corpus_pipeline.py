"""The corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, packing into contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import discard, stored, table
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.language_id import keep_identified
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import keep_one_of_each
from millrace.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose language can't be told go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the smallest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the smallest id stays."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: equal target weights for all sources, over four fifths of the blocks."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: a bin and an offset for every token of what is left."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: Not expressible in SQL: the conditional random field, MinHash and branch and bound. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored as Parquet in the shared folder and read again.

    A stage's table is deleted once the next one is stored; that of the last but one stays for the result to read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
