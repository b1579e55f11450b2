"""Text sources: whole files, uploads, PDF through a hook, and rows in memory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import MAX_SOURCE_BYTES
from ..operators.records import acceptable_upload
from ..operators.split import numbered


def read_source(spark: SparkSession, path: str, max_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """``(doc_id, path, text)`` of the UTF-8 files under ``path``; ``doc_id`` counts from 0 in the order of paths.

    A file of more than ``max_bytes`` is an error when the text is read; sizes are known from the listing alone.
    """
    files = spark.read.format("binaryFile").load(path)
    over = F.raise_error(F.concat(F.lit("source file is too large: "), F.col("path"))).cast("binary")
    content = F.when(F.col("length") > max_bytes, over).otherwise(F.col("content"))
    # Paths alone are numbered, by partition; contents are not read for it.
    places = numbered(files.select("path"), ["path"], "doc_id")
    return files.join(places, "path").select("doc_id", "path", F.decode(content, "UTF-8").alias("text"))


def read_uploads(
    spark: SparkSession, path: str, pdf_text: Callable[[bytes], str] | None = None
) -> DataFrame:
    """``(name, text)`` of the uploaded files that can be read, one row each.

    Files with unsafe names or beyond the size limit are left out, and so are those that don't parse. PDF files need
    ``pdf_text``, a function from bytes to text; without it they are left out.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    name = F.url_decode(name)
    sound = files.filter(acceptable_upload(name, F.col("length"))).withColumn("name", name)
    pdf = F.lower("name").endswith(".pdf")
    plain = sound.filter(~pdf).select("name", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    if pdf_text is None:
        return plain.filter("text IS NOT NULL")

    @F.pandas_udf("string")
    def parse(contents: pd.Series) -> pd.Series:
        def one(content):
            try:
                return pdf_text(bytes(content))
            except Exception:  # noqa: BLE001 - a file that doesn't parse is left out, whatever the parser raises
                return None

        return contents.map(one)

    parsed = sound.filter(pdf).select("name", parse("content").alias("text"))
    return plain.unionByName(parsed).filter("text IS NOT NULL")


def merge_uploads(uploads: DataFrame) -> DataFrame:
    """One row ``text``: all uploads by name, each followed by a blank line. For sources of a driver's size only."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("name", "text"))), lambda u: F.concat(u["text"], F.lit("\n\n")))
    return uploads.agg(F.array_join(parts, "").alias("text"))


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of rows in memory; keys that a row lacks are null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        raise ValueError("no rows")
    return spark.createDataFrame(pd.DataFrame([{k: r.get(k) for k in names} for r in rows], columns=names))
