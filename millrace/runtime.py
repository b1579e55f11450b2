"""The folder that all executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only where that is unset, and only on a local master, a temporary folder takes its place; on a cluster a missing
    setting is an error, as executors do not share local disks.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the shared folder, so that a lost executor costs no rework."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__mr_{stem}"
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return names
