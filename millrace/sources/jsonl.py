"""JSON Lines: numbered lines, records, and sinks that keep the order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import MAX_RECORDS


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of the text files under ``path``, numbered from 1 through all files by name.

    Rows keep their place within a split of a file, so a line's number follows from the counts of the splits before it:
    one small aggregation and no shuffle of the lines.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begin"),
        F.monotonically_increasing_id().alias("id"),
    )
    splits = raw.groupBy("file", "begin").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = "sum(n) OVER (ORDER BY file, begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = splits.selectExpr("file", "begin", "first", f"coalesce({before}, 0) AS start")
    return raw.join(starts, ["file", "begin"]).select((F.col("start") + F.col("id") - F.col("first") + 1).alias("line_no"), "line")


def _variant(parsed: Column, path: str) -> Column:
    return F.try_variant_get(parsed, path, "variant")


def _truthy(value: Column) -> Column:
    """Whether a JSON value is neither absent, null, empty, zero nor false."""
    kind, shown = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.coalesce(shown.try_cast("double") != 0, F.lit(True))
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "STRING", shown != "")
        .when(kind == "BOOLEAN", shown == "true")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~shown.isin("[]", "{}"))
        .otherwise(number)
    )


def parse_records(lines: DataFrame, max_records: int = MAX_RECORDS) -> DataFrame:
    """``(rec_id, instruction, input, output)`` of the lines that hold a record.

    Lines beyond ``max_records``, blank and malformed ones, and JSON that is no object give none. The output is that of
    ``output`` or, where it is absent, null, empty, zero or false, of ``generation``; without either, or without an
    instruction, there is no record. An absent ``input`` is empty, a null one stays null. Values that are not strings
    are written as JSON.
    """
    parsed = lines.filter(F.col("line_no") <= max_records).select(
        F.col("line_no").cast("long").alias("rec_id"), F.try_parse_json(F.trim("line")).alias("v")
    )
    parsed = parsed.filter(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    fields = {f: _variant(F.col("v"), f"$.{f}") for f in ("instruction", "input", "output", "generation")}
    as_text = {f: F.try_variant_get("v", f"$.{f}", "string") for f in fields}
    has_input = F.coalesce(F.array_contains(F.json_object_keys(F.to_json("v")), "input"), F.lit(False))
    return parsed.filter(_truthy(fields["instruction"]) & (_truthy(fields["output"]) | _truthy(fields["generation"]))).select(
        "rec_id",
        as_text["instruction"].alias("instruction"),
        F.when(has_input, as_text["input"]).otherwise("").alias("input"),
        F.when(_truthy(fields["output"]), as_text["output"]).otherwise(as_text["generation"]).alias("output"),
    )


def as_json(rows: DataFrame, order: str | None = None) -> DataFrame:
    """``(order, value)``: every row as a JSON object of its other columns; nulls are written."""
    names = [c for c in rows.columns if c != order]
    value = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")
    return rows.select(*([order] if order else []), value)


def write_jsonl(rows: DataFrame, path: str, order: str | None = "rec_id", single_file: bool = False) -> None:
    """Write the rows as JSON Lines, in the order of a column that is not written itself; replaces what is there.

    Files are numbered in the order of the range-partitioned rows. ``single_file`` is for results of one machine's size.
    """
    lines = as_json(rows, order)
    if order:
        lines = lines.orderBy(order).select("value")
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)


def replace_lines(lines: DataFrame, path: str, order: str = "rec_id") -> bool:
    """Put lines ``(order, value)`` in the place of ``path``, or leave it as it is where there are none or writing fails.

    The lines are written next to it first. When they are complete the original is moved aside, they take its place,
    and only then is it deleted; if they can't be moved it is put back. Returns whether they took the place.
    """
    spark = lines.sparkSession
    name = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, new, old = hadoop(path), hadoop(f"{name}.new"), hadoop(f"{name}.old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        lines.orderBy(order).select("value").write.text(new.toString())
        if spark.read.text(new.toString()).isEmpty():
            return False
        there = fs.exists(target)
        if there and not _rename(fs, target, old):
            return False
        moved = False
        try:
            moved = _rename(fs, new, target)
        finally:
            if there and not moved and not _rename(fs, old, target):
                raise OSError(f"{path} could not be put back; it is kept as {old.toString()}")
        if there:
            fs.delete(old, True)
        return moved
    finally:
        if fs.exists(new):
            fs.delete(new, True)


def _rename(fs, source, target) -> bool:
    """Whether a folder could be renamed."""
    return bool(fs.rename(source, target))
