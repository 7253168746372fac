"""Summaries and distribution datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callnet.functions.ordering import quantiles, ranked
from callnet.functions.scalars import safe_ratio

EMITTER_PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
QUARTILES = (0.25, 0.5, 0.75)


def with_rates(emitters: DataFrame) -> DataFrame:
    """P2. Calls per receiver."""
    return emitters.withColumn("calls_per_receiver", safe_ratio(F.col("total_calls_make"), F.col("unique_receivers")))


def global_summary(emitters: DataFrame) -> DataFrame:
    """G3. Distinct callers, sums, means, exact medians."""
    e = with_rates(emitters)
    measured = ["total_calls_make", "calls_per_receiver"]
    medians = quantiles(e.select(*[F.col(c).cast("double").alias(c) for c in measured]).unpivot([], measured, "metric", "x"), "metric", "x", (0.5,))
    medians = medians.agg(*[F.max(F.when(F.col("metric") == c, F.col("p")[0])).alias(f"median_{c}") for c in measured])
    sums = e.agg(
        F.countDistinct("id_emisor").alias("n_emitters"), F.sum("total_calls_make").alias("total_calls"), F.sum("unique_receivers").alias("total_receivers"), F.round(F.avg("total_calls_make"), 6).alias("mean_calls"),
        F.round(F.avg("calls_per_receiver"), 6).alias("mean_calls_per_receiver"),
    )
    out = sums.join(F.broadcast(medians))  # one row each
    return out.select(
        "n_emitters", "total_calls", "total_receivers", "mean_calls", F.col("median_total_calls_make").alias("median_calls"), "mean_calls_per_receiver", F.round("median_calls_per_receiver", 6).alias("median_calls_per_receiver")
    )


def describe(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = QUARTILES) -> DataFrame:
    """G4, G5, R4. One row per column: count, mean, sample deviation, min, exact interpolated percentiles, max; nulls are skipped."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "x")
    got = long.groupBy("metric").agg(
        F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"),
    ).join(quantiles(long, "metric", "x", percentiles), "metric", "left")
    return got.select("metric", "n", "mean", "std", "min", *[F.round(F.col("p")[i], 6).alias(f"p{round(100 * p):02d}") for i, p in enumerate(percentiles)], "max")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """H1-H3. Equal-width bins with their bounds and counts, empty bins included; the last bin holds the maximum. A constant column gets a width of 1 around it."""
    x = df.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    edge = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a IS NOT NULL")
    edge = edge.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    binned = x.join(F.broadcast(edge)).select(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    axis = edge.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return axis.join(counts, "bin", "left").select("bin", F.round(F.col("lo") + width * F.col("bin"), 6).alias("lower"), F.round(F.col("lo") + width * (F.col("bin") + 1), 6).alias("upper"), F.coalesce("c", F.lit(0)).alias("n"))


def integer_histogram(df: DataFrame, column: str) -> DataFrame:
    """H4. Counts of 0..max, zeros included."""
    counts = df.groupBy(F.col(column).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    axis = counts.agg(F.max("value").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("value"))
    return axis.join(counts, "value", "left").select("value", F.coalesce("c", F.lit(0)).alias("n"))


def survival_by_row(df: DataFrame, column: str, tie: list[str]) -> DataFrame:
    """W7, H8. 1 - i / n over the sorted values; ties get distinct shares."""
    rows = df.select(F.col(column).alias("value"), *tie).where("value IS NOT NULL")
    n = rows.agg(F.count(F.lit(1))).scalar()
    got = ranked(rows, [F.col("value"), *[F.col(t) for t in tie]])
    return got.select(*tie, "value", F.round(1 - (F.col("rank") - 1) / n, 9).alias("survival"))


def survival_by_value(df: DataFrame, column: str) -> DataFrame:
    """W8, H8. P(X >= k) for each value. The window runs over the histogram, one row per value."""
    h = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_k")).where("value IS NOT NULL")
    upper = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    return h.select("value", "n_k", F.round(F.sum("n_k").over(upper) / F.sum("n_k").over(Window.partitionBy()), 9).alias("survival"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """H6."""
    return df.select(x, y).dropna()
