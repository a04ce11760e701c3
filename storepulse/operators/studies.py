"""Threshold and classifier studies. Similarities are rows (kind, sim), or counted ones (kind, sim, pairs) as knn.similarity_counts gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairs(sims: DataFrame, where=None):
    """How many similarities the rows of sims stand for: `pairs` each if there is such a column, one each if not."""
    each = F.col("pairs") if "pairs" in sims.columns else F.lit(1).cast("bigint")
    return F.sum(each if where is None else F.when(where, each).otherwise(0))


def quantile_picks(sims: DataFrame, points: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """kind, n, p10...: of each kind's sorted similarities the element number n * p // 100, exact, by ranks of (kind, sim) counts."""
    w = Window.partitionBy("kind").orderBy("sim")
    counts = sims.groupBy("kind", "sim").agg(_pairs(sims).alias("c"))
    placed = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("kind")))
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("sim")))
    return placed.groupBy("kind").agg(F.max("n").alias("n"), *(pick(p).alias(f"p{p}") for p in points))


def f1_sweep(sims: DataFrame, low: int = 0, high: int = 100) -> DataFrame:
    """threshold, tp, fp, fn, f1 for thresholds low/100 to high/100: same pairs at or over it are found. One aggregation by whole hundredths."""
    spark = sims.sparkSession
    step = F.floor(F.round(F.col("sim") * 100, 6)).alias("step")
    bins = sims.groupBy(step).agg(_pairs(sims, F.col("kind") == "same").alias("same"), _pairs(sims, F.col("kind") == "different").alias("different"))
    grid = spark.range(low, high + 1).select(F.col("id").alias("at"))
    # a hundred thresholds by the bins of one similarity range
    found = grid.join(F.broadcast(bins), F.col("step") >= F.col("at"), "left").groupBy("at").agg(F.coalesce(F.sum("same"), F.lit(0)).alias("tp"), F.coalesce(F.sum("different"), F.lit(0)).alias("fp"))
    total = bins.agg(F.sum("same").alias("positives"))
    out = found.crossJoin(F.broadcast(total)).withColumn("fn", F.col("positives") - F.col("tp"))
    low_part = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return out.select((F.col("at") / 100).alias("threshold"), "tp", "fp", "fn", F.round(F.when(low_part > 0, 2 * F.col("tp") / F.when(low_part > 0, low_part)).otherwise(F.lit(0.0)), 6).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the best f1."""
    return sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def similarity_histogram(sims: DataFrame) -> DataFrame:
    """kind, bin, n in steps of .05; the cast cuts towards 0."""
    return sims.groupBy("kind", ((F.col("sim") * 20).cast("int") / 20).alias("bin")).agg(_pairs(sims).alias("n"))


def classifier_comparison(rows: DataFrame, methods: list[str], subsets: list[str]) -> DataFrame:
    """method, subset, n, correct, wrong, abstained, f_to_m, m_to_f of predictions (columns, null: abstains) against truth, over flagged subsets."""
    long = rows.select("truth", F.explode(F.array(F.lit("all"), *(F.when(F.col(s), F.lit(s)) for s in subsets))).alias("subset"), *methods).filter("subset IS NOT NULL")
    each = long.unpivot(["truth", "subset"], methods, "method", "said")
    hit = F.col("said") == F.col("truth")
    return each.groupBy("method", "subset").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.count_if(F.col("said") != F.col("truth")).alias("wrong"), F.count_if(F.col("said").isNull()).alias("abstained"),
        F.count_if((F.col("truth") == "F") & (F.col("said") == "M")).alias("f_to_m"), F.count_if((F.col("truth") == "M") & (F.col("said") == "F")).alias("m_to_f"),
    )


def margin_sweep(samples: DataFrame, deltas: list[float]) -> DataFrame:
    """how, delta, errors, m_to_f, f_to_m, best: per person the mean, median or majority of margins against each threshold.

    Means are rounded to 12 digits: one that is the threshold itself is not over it, in whatever order its margins were summed."""
    spark = samples.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(d) for d in deltas))).alias("delta"))
    people = samples.groupBy("person_id").agg(F.first("truth").alias("truth"), F.round(F.avg("margin"), 12).alias("mean"), F.percentile("margin", F.lit(0.5)).alias("median"), *(F.avg((F.col("margin") > d).cast("double")).alias(f"share_{i}") for i, d in enumerate(deltas)))
    majority = F.element_at(F.array(*(F.col(f"share_{i}") for i in range(len(deltas)))), F.array_position(F.array(*(F.lit(d) for d in deltas)), F.col("delta")).cast("int"))
    rows = people.crossJoin(F.broadcast(grid)).select("truth", "delta", F.explode(F.map_from_arrays(F.array(F.lit("mean"), F.lit("median"), F.lit("majority")), F.array(F.col("mean") > F.col("delta"), F.col("median") > F.col("delta"), majority > 0.5))).alias("how", "male"))
    out = rows.groupBy("how", "delta").agg(F.count_if((F.col("truth") == "M") != F.col("male")).alias("errors"), F.count_if((F.col("truth") == "M") & ~F.col("male")).alias("m_to_f"), F.count_if((F.col("truth") == "F") & F.col("male")).alias("f_to_m"))
    w = Window.orderBy("errors", "m_to_f", "f_to_m", "delta", "how")  # one row per way and threshold
    return out.withColumn("best", F.row_number().over(w) == 1)


def midpoint(quantiles: DataFrame) -> DataFrame:
    """Halfway between the low same-person and the high different-person similarities: (p10 of same + p90 of different) / 2."""
    of = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    return quantiles.agg(F.round((of("same", "p10") + of("different", "p90")) / 2, 6).alias("midpoint"))
