"""Export of raw generations as a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.dedup import deduplicate
from ..operators.formats import check_format, convert
from ..sources.jsonl import MAX_RECORDS, parse_records, read_lines, write_jsonl


def export_records(lines: DataFrame, name: str = "alpaca", dedup: bool = True, max_records: int = MAX_RECORDS) -> DataFrame:
    """``rec_id`` and the columns of the format for the numbered raw lines."""
    check_format(name)
    records = parse_records(lines, max_records)
    return convert(deduplicate(records) if dedup else records, name, keep=["rec_id"])


def export_dataset(
    spark: SparkSession, source: str, target: str, name: str = "alpaca", dedup: bool = True, max_records: int = MAX_RECORDS
) -> int:
    """Read raw JSON Lines, write the dataset in the named format, and return the number of its records."""
    check_format(name)
    write_jsonl(export_records(read_lines(spark, source), name, dedup, max_records), target)
    return spark.read.text(target).count()


def export_alpaca(spark: SparkSession, source: str, target: str) -> int:
    """Alpaca export without deduplication."""
    return export_dataset(spark, source, target, "alpaca", dedup=False)
