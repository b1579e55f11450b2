"""Mixing of sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, matching, table

SEED = 17
BLOCK_TOKENS = 4096
DOCS_PER_SHARD = 32768
BUDGET = 0.8


def token_count(text: Column) -> Column:
    """White-space separated tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _order_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def mixing_plan(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    budget: float = BUDGET,
    block_tokens: int = BLOCK_TOKENS,
    docs_per_shard: int = DOCS_PER_SHARD,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rejected: bool = False,
) -> DataFrame:
    """``(doc_id, source, n_tokens, shard, block)`` of the documents in the selected (or, ``rejected``, the other) blocks.

    1. Documents are spread over ``ceil(documents / docs_per_shard)`` shards by a seeded hash of their id, so every
       window below sorts a bounded number of narrow rows at any size of the corpus.
    2. In each shard and source the documents, in seeded order, are cut into blocks of ``block_tokens``: a document
       belongs whole to the block that holds its first token.
    3. Each shard fills ``floor(budget * blocks)`` seats (one at least). Seat by seat they go to the source with the
       highest quotient ``weight / (2 * seats so far + 1)`` that still has blocks, ties to the smaller source name:
       integer quotas by Sainte-Laguë, capped by supply.
    4. Each source's quota is drawn from its blocks in seeded order.

    ``weights`` maps sources to weights (others get ``default_weight``; 0 excludes a source). Text never enters a
    shuffle. Defined cases: a null source is a source of its own, sorted first; null or empty texts have 0 tokens and
    go with the block at their place; a text of any length is counted whole and belongs to one block; ids may be of any
    type that has an order; rows that repeat an id within a source are one unit with their summed tokens; rows with a
    null id form one unit per source; an empty table gives an empty plan; other columns are not read, whatever their
    names.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("n_tokens")
    )
    units = narrow.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    shards = docs.select(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(docs_per_shard))).alias("n_shards"))
    key = _order_key(seed, F.col("doc_id"))
    units = units.crossJoin(F.broadcast(shards)).select(
        "doc_id",
        "source",
        "n_tokens",
        key.alias("key"),
        F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.col("n_shards")).alias("shard"),
    )
    before = Window.partitionBy("shard", "source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn(
        "block",
        F.floor(F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) / F.lit(block_tokens)).cast("long"),
    ).select("doc_id", "source", "n_tokens", "shard", "block")

    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == F.lit(name), F.lit(float(value))).otherwise(weight)
    blocks = placed.select("shard", "source", "block").distinct()
    supply = blocks.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("supply")).withColumn("weight", weight)
    seats = Window.partitionBy("shard")
    supply = supply.withColumn(
        "seats", F.greatest(F.lit(1), F.floor(F.sum("supply").over(seats) * F.lit(float(budget)))).cast("long")
    ).filter("weight > 0")
    quotients = supply.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("supply")))).withColumn(
        "quotient", F.col("weight") / (2 * F.col("j") - 1).cast("double")
    )
    best = Window.partitionBy("shard").orderBy(F.desc("quotient"), F.col("source").asc_nulls_first())
    quotas = (
        quotients.withColumn("rank", F.row_number().over(best))
        .filter("rank <= seats")
        .groupBy("shard", "source")
        .agg(F.count(F.lit(1)).alias("quota"))
    )
    draw = Window.partitionBy("shard", "source").orderBy(
        _order_key(seed, F.col("shard"), F.col("source"), F.col("block")), "block"
    )
    drawn = blocks.withColumn("draw", F.row_number().over(draw)).alias("b")
    same = (F.col("b.shard") == F.col("q.shard")) & F.col("b.source").eqNullSafe(F.col("q.source"))
    drawn = drawn.join(quotas.alias("q"), same).filter("b.draw <= q.quota").select("b.shard", "b.source", "b.block").alias("d")
    chosen = (
        (F.col("p.shard") == F.col("d.shard"))
        & (F.col("p.block") == F.col("d.block"))
        & F.col("p.source").eqNullSafe(F.col("d.source"))
    )
    kept = placed.alias("p").join(drawn, chosen, "left_anti" if rejected else "left_semi")
    return kept.select("p.doc_id", "p.source", "p.n_tokens", "p.shard", "p.block")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **params) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that the mixing plan selects.

    See ``mixing_plan`` for the defined cases. Rows are taken out by the units of the other blocks, the lesser part:
    texts stay where they are unless these are too many to be broadcast (``common.matching``).
    """
    id_, source = fresh(docs, "id", "source")
    out = mixing_plan(docs, id_col=id_col, source_col=source_col, rejected=True, **params)
    out = cut(out.select(F.col("doc_id").alias(id_), F.col("source").alias(source)))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & F.col(source_col).eqNullSafe(F.col(source))
    return matching(docs, out, same, out.count(), anti=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the selected blocks, every source with the same target weight."""
    return mixing_plan(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH units AS (
  SELECT doc_id, source, sum(n_tokens)::BIGINT AS n_tokens, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS n_tokens FROM documents)
  GROUP BY doc_id, source
), shards AS (
  SELECT greatest(1, ceil(count(*) / {DOCS_PER_SHARD}.0))::BIGINT AS n_shards FROM documents
), placed AS (
  SELECT doc_id, source, n_tokens, shard, (coalesce(sum(n_tokens) OVER (
    PARTITION BY shard, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ), 0)::BIGINT // {BLOCK_TOKENS})::BIGINT AS block
  FROM (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % n_shards AS shard FROM units, shards)
), blocks AS (
  SELECT DISTINCT shard, source, block FROM placed
), supply AS (
  SELECT *, greatest(1, floor(sum(supply) OVER (PARTITION BY shard) * {BUDGET}::DOUBLE))::BIGINT AS seats
  FROM (SELECT shard, source, count(*) AS supply FROM blocks GROUP BY shard, source)
), quotients AS (
  SELECT shard, source, seats, 1.0::DOUBLE / (2 * j - 1)::DOUBLE AS quotient
  FROM (SELECT *, unnest(range(1, supply + 1)) AS j FROM supply)
), quotas AS (
  SELECT shard, source, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY quotient DESC, source NULLS FIRST) AS rank FROM quotients)
  WHERE rank <= seats GROUP BY shard, source
), drawn AS (
  SELECT *, row_number() OVER (
    PARTITION BY shard, source ORDER BY md5('{SEED}:' || shard || ':' || coalesce(source, '') || ':' || block), block
  ) AS draw FROM blocks
)
SELECT p.doc_id, p.source, p.n_tokens, p.shard, p.block
FROM placed p
JOIN drawn d ON p.shard = d.shard AND p.source IS NOT DISTINCT FROM d.source AND p.block = d.block
JOIN quotas q ON d.shard = q.shard AND d.source IS NOT DISTINCT FROM q.source
WHERE d.draw <= q.quota
"""
