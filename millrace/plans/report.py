"""Scoring of a written dataset."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import score


def score_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``operators.score.score`` of the JSON Lines at ``path``, in one row.

    Blank and malformed lines and JSON that is no object are left out. What can't be found is a DISASTER, like a dataset
    without any record.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        none = score(spark.createDataFrame([], "instruction string, output string"))
        return none.withColumn("details", F.lit("Could not read dataset file."))
    parsed = lines.select(F.try_parse_json(F.trim("value")).alias("v"))
    parsed = parsed.filter(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    return score(parsed.select(*[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in ("instruction", "output")]))
