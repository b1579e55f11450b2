"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, fresh, shared_folder

__all__ = ["BROADCAST_ROWS", "cut", "discard", "fresh", "integer_id", "matching", "stored", "table"]

#: Most keys (some 200 bytes each once hashed) that are broadcast to filter a table of texts; with more, the texts are shuffled.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in the shared folder and read again, with its lineage cut; and the path."""
    path = f"{shared_folder(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long; a column that holds no integers is a ValueError, as ids are the identity of rows and stay whole."""
    kind = docs.select(id_col).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"{id_col} must hold integers, not {kind}; number the rows first")
    return F.col(id_col).cast("long")


def matching(docs: DataFrame, keys: DataFrame, same: Column, n_keys: int, anti: bool = False) -> DataFrame:
    """The rows of ``docs`` with (or, ``anti``, without) a row of ``keys`` that matches by ``same``.

    Up to ``BROADCAST_ROWS`` keys are broadcast, so that texts stay where they are; with more, both sides are shuffled
    by key. The rows are the same either way.
    """
    side = keys.hint("broadcast" if n_keys <= BROADCAST_ROWS else "shuffle_hash")
    return docs.join(side, same, "left_anti" if anti else "left_semi")
