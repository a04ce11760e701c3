"""Mixing sources to target weights, with DataFrame functions only.

Plan: one scan aggregates sizes by source; targets and rates are computed over the table of sources; a second scan
joins each document to its source's rate and draws its copies from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.plans.lineage import cut

#: Sources up to this number are broadcast; beyond, the join is shuffled and skewed sources are split by AQE.
BROADCAST_SOURCES = 20_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, source_size).

    Sources by code point, null last, take the weights in turn. They share `share` of all sizes by weight; a target
    stops at `most` times its source's size, and what is over is shared again until none is above. In closed form:
    with the sources in order of cap / weight, the capped ones are a prefix, and the rest get level * weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    named = named.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    up = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    levels = named.withColumn("level", level)
    settled = levels.withColumn("final", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    target = F.when(F.col("level") <= F.col("ratio"), F.col("w") * F.col("final")).otherwise(F.col("cap"))
    return settled.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the key: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per row of docs, with the columns of `keep` after them.

    A document is taken floor(rate) times, rate = target / source_size, plus once more with the probability of the
    fraction, drawn from a hash of its id. Null text has size 0; null source is a source; a source without words has
    target 0. Rows with equal ids draw alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep or []))
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = targets.withColumnRenamed("source", "of")
    joined = sized.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    out = joined.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(F.col(f"kept_{c}") for c in keep or []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of docs."""
    mixed = mix_sources(docs, keep=docs.columns, **options)
    times = mixed.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return times.select(*(F.col(f"`kept_{c}`").alias(c) for c in docs.columns))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT source, source_size, w, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM (
    SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s)
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER up, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0.0)) AS level
  FROM named WINDOW up AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN level <= ratio THEN w * (max(CASE WHEN level <= ratio THEN level END) OVER ()) ELSE cap END AS target FROM levels
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u FROM rated
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken,
  CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies
FROM drawn
"""
