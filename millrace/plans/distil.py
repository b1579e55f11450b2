"""The whole job: documents to chunks to prompts to generations to a sanitised dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import chunk_documents
from ..operators.formats import REQUIRED
from ..operators.records import finished_hashes, prompts, remaining
from ..operators.split import ensemble_split, first_rows, numbered
from ..runtime import cut
from ..sources.jsonl import as_json, read_lines, replace_lines, write_jsonl
from .config import GenerationConfig
from .export import export_records
from .generate import Model, distil
from .sanitize import Sanitizer, sanitize_lines


def prompt_rows(docs: DataFrame, config: GenerationConfig) -> DataFrame:
    """``(doc_id, chunk_no, chunk, prompt)`` of the first ``dataset_size`` chunks in document order."""
    chunks = chunk_documents(docs, config.use_semantic_chunking)
    return prompts(first_rows(chunks, config.dataset_size, ["doc_id", "chunk_no"]))


def read_checkpoint(spark: SparkSession, folder: str | None) -> DataFrame:
    """Hashes of finished prompts; none where there is no folder or it can't be read."""
    none = spark.createDataFrame([], "prompt_hash string")
    if not folder:
        return none
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return none
    try:
        return cut(spark.read.schema("prompt_hash string").parquet(folder))
    except Exception:  # noqa: BLE001 - an unreadable checkpoint counts as none
        return none


def write_checkpoint(done: DataFrame, folder: str | None) -> None:
    """Add hashes to the checkpoint."""
    if folder:
        done.write.mode("append").parquet(folder)


def sanitize_in_place(spark: SparkSession, path: str, name: str, settings: Sanitizer | None = None) -> bool:
    """Sanitise a written dataset and put the result in its place, unless nothing is left. Returns whether it did."""
    settings = settings or Sanitizer(require_fields=tuple(REQUIRED.get(name, ["instruction", "output"])))
    kept = sanitize_lines(read_lines(spark, path), settings).filter("status = 'kept'")
    return replace_lines(cut(kept.select("rec_id", "value")), path)


def run(
    docs: DataFrame,
    model_of: Callable[[str], Model],
    config: GenerationConfig,
    target: str,
    progress: Callable[[int], None] = lambda percent: None,
) -> str:
    """Generate a dataset from ``(doc_id, text)`` and write it to ``target`` as JSON Lines; returns the path.

    Prompts in the checkpoint are not generated again. Several models share the prompts in contiguous blocks, and the
    dataset keeps the order of models, documents and chunks.
    """
    spark = docs.sparkSession
    progress(5)
    todo = remaining(prompt_rows(docs, config), read_checkpoint(spark, config.checkpoint_dir))
    todo = ensemble_split(todo, config.models, ["doc_id", "chunk_no"])
    if todo.isEmpty():
        raise ValueError("there are no prompts to generate from")
    progress(20)
    parts = []
    for i, name in enumerate(config.models):
        rows = todo.filter(F.col("part") == i).withColumn("instruction", F.col("prompt"))
        made = distil(
            rows, model_of(name), config.quality_mode.evolutions, config.batch_size, keep=("part", "doc_id", "chunk_no")
        )
        parts.append(made)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    progress(70)
    order = ["part", "doc_id", "chunk_no"]
    raw = cut(numbered(merged, order, "row"))
    lines = as_json(raw.select("row", "instruction", "output"), "row").select(
        (F.col("row") + 1).alias("line_no"), F.col("value").alias("line")
    )
    write_jsonl(export_records(lines, config.output_format.value, config.enable_dedup), target)
    progress(80)
    if config.sanitize_dataset:
        sanitize_in_place(spark, target, config.output_format.value)
    progress(85)
    write_checkpoint(finished_hashes(todo), config.checkpoint_dir)
    progress(100)
    return target
