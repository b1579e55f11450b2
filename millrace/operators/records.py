"""Filters and gates on records, and what a checkpoint leaves to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import MAX_UPLOAD_BYTES, PROMPT, SAFE_NAME, WARN_UPLOAD_BYTES


def rename_outputs(rows: DataFrame, min_length: int = 100) -> DataFrame:
    """Rows whose generation is longer than ``min_length``, with it as ``output``; other columns stay."""
    return rows.filter(F.length("generation") > min_length).withColumn("output", F.col("generation"))


def keep_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Projection."""
    return rows.select(*columns)


def prompts(chunks: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """The chunks with the prompt that asks about each."""
    return chunks.withColumn("prompt", F.concat(F.lit(PROMPT), F.col(chunk_col)))


def filled(column: Column, kind: str) -> Column:
    """Whether a required field of the given Spark type counts as present.

    Null, blank strings and empty arrays, maps and structs do not; numbers and booleans do, zero and false among them.
    """
    if kind == "string":
        return F.coalesce(F.regexp_replace(column, r"[\s\p{Z}]+", "") != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    return column.isNotNull()


def has_required(rows: DataFrame, fields: list[str]) -> Column:
    """Whether all required fields are present; a field that the table lacks is not."""
    kinds = dict(rows.dtypes)
    return reduce(
        lambda a, b: a & b,
        [filled(F.col(f), kinds[f]) if f in kinds else F.lit(False) for f in fields],
        F.lit(True),
    )


def remaining(rows: DataFrame, done: DataFrame, prompt_col: str = "prompt", hash_col: str = "prompt_hash") -> DataFrame:
    """The rows whose prompt's SHA-256 is not among the finished ones."""
    finished = done.select(F.col(hash_col).alias("__mr_done")).distinct()
    return rows.join(finished, F.sha2(F.col(prompt_col), 256) == F.col("__mr_done"), "left_anti")


def finished_hashes(rows: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """The hashes of finished prompts, as a checkpoint stores them."""
    return rows.select(F.sha2(F.col(prompt_col), 256).alias("prompt_hash")).distinct()


def safe_name(name: Column) -> Column:
    """Whether a file name may be read."""
    return name.rlike(SAFE_NAME)


def acceptable_upload(name: Column, length: Column) -> Column:
    """Whether an uploaded file is read: a safe name and no more than the hard limit of bytes."""
    return safe_name(name) & (length <= MAX_UPLOAD_BYTES)


def large_upload(files: DataFrame, length_col: str = "length") -> DataFrame:
    """One row ``(total_bytes, warn)``: the bytes of all files, and whether they are so many that work takes long."""
    total = F.coalesce(F.sum(length_col), F.lit(0))
    return files.agg(total.alias("total_bytes"), (total > WARN_UPLOAD_BYTES).alias("warn"))
