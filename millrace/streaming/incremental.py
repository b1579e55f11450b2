"""Sanitising of JSON lines as they arrive, each record once however often a batch is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import pii
from ..functions.quality import reason
from ..functions.text import clean_text, quality_text, record_hash
from ..plans.sanitize import Sanitizer

FIELDS = ("instruction", "input", "output")


def sanitized_stream(spark: SparkSession, source: str, settings: Sanitizer = Sanitizer()) -> DataFrame:
    """A stream of the sanitised records that pass the gates, from JSON files arriving in a folder.

    All steps are built-in expressions of one row, so no state is kept here; ``settings.deduplicate`` belongs to the sink.
    """
    rows = spark.readStream.schema(", ".join(f"{f} string" for f in FIELDS)).json(source)
    for f in FIELDS:
        rows = rows.withColumn(f, clean_text(F.col(f), settings.clean_html))
        if settings.remove_pii:
            rows = rows.withColumn(f, pii.redact_pii(F.col(f), settings.pii_mask))
    passed = reason(quality_text([F.col(f) for f in FIELDS]), settings.gates).isNull()
    return rows.filter(passed).withColumn("record_hash", record_hash({f: F.col(f) for f in FIELDS}))


def start(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's new records to a Parquet table partitioned by the batch that brought them.

    A record whose hash an earlier batch wrote is left out. A retried batch replaces its own partition, so that every
    record is there exactly once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(["record_hash"])
        try:
            before = spark.read.parquet(target).filter(F.col("epoch") < epoch).select("record_hash")
            new = new.join(before, "record_hash", "left_anti")
        except Exception as error:  # noqa: BLE001 - the table's first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        new.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
