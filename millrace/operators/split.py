"""Limits in document order, and contiguous splits among several models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, fresh


def first_rows(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in the order of some columns."""
    return rows.orderBy(*order).limit(n)


def line_limit(lines: DataFrame, n: int, line_col: str = "line_no") -> DataFrame:
    """The lines up to number ``n``, blank and malformed ones counted."""
    return lines.filter(F.col(line_col) <= n)


def numbered(rows: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """The rows with their place (from 0) in a total order, without a single-partition window.

    Rows are range-partitioned by the order; each partition is numbered by itself and shifted by the sizes of those
    before it. Ranges and places are computed once and checkpointed in the shared folder: a plan that was run again for
    the sizes could be cut into other partitions, and rows would be lost or share a place.
    """
    at, part, start = fresh(rows, "at", "part", "start")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ranged = cut(ranged).withColumn(part, F.shiftright(at, 33))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(start))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    within = F.col(at) - F.shiftleft(F.col(part), 33)
    # One row per partition: the sizes are as many as there were tasks, whatever the table's length.
    return ranged.join(F.broadcast(starts), part).select(*rows.columns, (F.col(start) + within).alias(name))


def ensemble_split(rows: DataFrame, models: list[str], order: list[str]) -> DataFrame:
    """The rows with the model that answers each: contiguous blocks of equal size, the last model takes the rest.

    An empty list of models is an error.
    """
    names = [m.strip() for m in models if m.strip()]
    if not names:
        raise ValueError("at least one model is needed")
    row, size = fresh(rows, "row", "size")
    placed = numbered(rows, order, row)
    sizes = placed.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / F.lit(len(names)))).alias(size))
    part = F.least(F.floor(F.col(row) / F.col(size)), F.lit(len(names) - 1)).cast("int")
    return (
        placed.crossJoin(F.broadcast(sizes))
        .withColumn("part", part)
        .withColumn("model", F.element_at(F.array(*map(F.lit, names)), F.col("part") + 1))
        .drop(row, size)
    )


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """All parts, one after another, with the number of the part that each row comes from."""
    if not parts:
        raise ValueError("no parts")
    out = parts[0].withColumn("part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("part", F.lit(i)))
    return out
