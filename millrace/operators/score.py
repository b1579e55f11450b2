"""Scores of a dataset, counters of a sanitising run, and the estimate of cost and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import DEFAULT_PRICE, EMPTY_DATASET, EVOLUTIONS, GRADES, PRICES, SAME_INSTRUCTIONS, SHORT_OUTPUTS


def score(records: DataFrame) -> DataFrame:
    """One row ``(grade, record_count, avg_output_length, unique_ratio, details)``.

    Reads ``instruction`` and ``output`` only, absent ones as empty. An empty table is a DISASTER; otherwise the lowest
    grade is BAD, whatever the figures.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
    figures = records.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.avg(F.length(text("output"))), F.lit(0.0)).alias("avg_output_length"),
        F.coalesce(F.try_divide(F.count_distinct(text("instruction")), F.count(F.lit(1))), F.lit(0.0)).alias("unique_ratio"),
    )
    grade = F.when(F.col("record_count") == 0, "DISASTER")
    for name, records_, length, unique in GRADES:
        passed = (F.col("record_count") >= records_) & (F.col("avg_output_length") >= length) & (F.col("unique_ratio") >= unique)
        grade = grade.when(passed, name)
    short = F.when(F.col("avg_output_length") < 100, SHORT_OUTPUTS)
    same = F.when(F.col("unique_ratio") < 0.70, SAME_INSTRUCTIONS)
    details = F.concat_ws(
        " · ",
        F.format_string("%d records generated", "record_count"),
        F.format_string("Average output length: %.0f chars", F.rint("avg_output_length")),
        F.format_string("Instruction uniqueness: %.0f%%", F.rint(F.col("unique_ratio") * 100)),
        short,
        same,
    )
    details = F.when(F.col("record_count") == 0, EMPTY_DATASET).otherwise(details)
    return figures.select(grade.otherwise("BAD").alias("grade"), *figures.columns, details.alias("details"))


def counters(marked: DataFrame) -> DataFrame:
    """One row of a sanitising run's counters, from ``status`` and ``pii`` of every line."""
    count = lambda s: F.count_if(F.col("status") == s)
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        count("kept").alias("kept"),
        count("quality").alias("filtered_quality"),
        count("require").alias("filtered_require"),
        count("duplicate").alias("deduplicated"),
        F.count_if((F.col("status") == "kept") & F.col("pii")).alias("pii_redacted"),
    )


def total_bytes(files: DataFrame, length_col: str = "length") -> DataFrame:
    """One row with the bytes of all files."""
    return files.agg(F.coalesce(F.sum(length_col), F.lit(0)).alias("total_bytes"))


def estimate(model: str, size: int, mode: str, local: bool) -> tuple[str, str]:
    """Cost and time of generating ``size`` pairs, as shown to the user.

    The price is that of the first known name that the first model's name contains.
    """
    rounds = EVOLUTIONS.get(mode, 2)

    def minutes(seconds_per_pair: float) -> str:
        return f"~{max(1, int(size * rounds * seconds_per_pair / 60))} min"

    if local:
        return "Free (local GPU)", minutes(0.3)
    name = model.partition(",")[0].lower().strip()
    price = next((p for known, p in PRICES.items() if known in name), DEFAULT_PRICE)
    return f"~${size * 800 * rounds * (price / 1_000_000):.2f}", minutes(0.5)
