"""Exact deduplication by 128-bit content hash, confirmed byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, matching, table


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Column | None = None
) -> DataFrame:
    """The rows of ``docs`` (all its columns) without later copies of a text.

    Rows are grouped by the MD5 of the UTF-8 text (``hash_of`` replaces it, for tests of collisions); only the hashes
    are shuffled to find those that occur twice. Rows whose hash occurs once pass as they are. The others are grouped
    by hash and, within a hash, by the text itself: equal hashes of different bytes stay apart. Of a group the row with
    the smallest id stays. The filter on the row number lets Catalyst keep one row per group before the shuffle too
    (WindowGroupLimit), so a text with millions of copies sends at most one row per input partition.

    Defined cases: a null text is no content, so those rows are never copies and all stay; empty texts are equal to one
    another; texts of any length are compared whole; ids may be of any type that has an order, and a null id sorts after
    every other; of rows with the same id and text one stays, and where their other columns differ it is the one with
    the least of these as JSON, so that the result does not depend on the order of rows; an empty table gives an empty
    table; other columns, whatever their names, are carried along.
    """
    key, rank, again, others = fresh(docs, "hash", "rank", "again", "others")
    hashed = docs.withColumn(key, F.unhex(F.md5(F.col(text_col))) if hash_of is None else hash_of)
    some = hashed.filter(F.col(text_col).isNotNull())
    twice = cut(some.groupBy(key).agg(F.count(F.lit(1)).alias(rank)).filter(F.col(rank) > 1).select(F.col(key).alias(again)))
    n_twice = twice.count()
    same = F.col(key) == F.col(again)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    content = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")
    repeated = matching(some, twice, same, n_twice).withColumn(others, content)
    first = Window.partitionBy(key, text_col).orderBy(F.col(id_col).asc_nulls_last(), others)
    kept = repeated.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
    once = matching(some, twice, same, n_twice, anti=True)
    kept = once.select(*docs.columns).unionByName(kept.select(*docs.columns))
    return kept.unionByName(docs.filter(F.col(text_col).isNull()))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with the hash of their text."""
    kept = exact_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("content_hash"))


OP9_SQL = """
SELECT doc_id, lang, source, n_chars, md5(text) AS content_hash
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS rn FROM documents)
WHERE rn = 1 OR text IS NULL
"""
