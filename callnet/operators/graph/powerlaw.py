"""Power-law fit of a degree sequence, on its histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_TAIL = 30


def candidates(histogram: DataFrame, least_tail: int = LEAST_TAIL) -> DataFrame:
    """(x_min, n_tail, alpha, ks) for each x_min from 1 below the greatest degree while the tail has `least_tail` nodes. histogram: (k, n_k).

    The self-join is over distinct degrees. Equal degrees make a run in the sorted tail; the greatest distance is at its first or last place.
    """
    h = histogram.where("k > 0")
    # no start beyond the last degree that leaves a tail of `least_tail`: few rows, however great the greatest degree is
    left = h.select("k", F.sum("n_k").over(Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)).alias("tail"), F.max("k").over(Window.partitionBy()).alias("top"))
    last = left.where(F.col("tail") >= least_tail).agg(F.max(F.least("k", F.col("top") - 1)).alias("last")).where("last >= 1")
    starts = last.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("x_min"))
    tail = starts.join(h, F.col("k") >= F.col("x_min"))
    fit = tail.groupBy("x_min").agg(F.sum("n_k").alias("n_tail"), F.sum(F.col("n_k") * F.ln(F.col("k") / (F.col("x_min") - 0.5))).alias("logs")).where(F.col("n_tail") >= least_tail)
    fit = fit.select("x_min", "n_tail", (1 + F.col("n_tail") / F.col("logs")).alias("alpha"))
    upto = Window.partitionBy("x_min").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    both = tail.join(fit, "x_min").withColumn("cum", F.sum("n_k").over(upto))
    model = 1 - F.pow(F.col("k") / F.col("x_min"), -(F.col("alpha") - 1))
    first, last = (F.col("cum") - F.col("n_k") + 1) / F.col("n_tail"), F.col("cum") / F.col("n_tail")
    gap = F.greatest(F.abs(first - model), F.abs(last - model))
    return both.withColumn("gap", gap).groupBy("x_min", "n_tail", "alpha").agg(F.max("gap").alias("ks"))


def power_law(histogram: DataFrame, least_tail: int = LEAST_TAIL) -> DataFrame:
    """N9. The candidate of least KS distance (the first on ties); no row if there is none."""
    return candidates(histogram, least_tail).orderBy("ks", "x_min").limit(1)


def power_law_curve(histogram: DataFrame, least_tail: int = LEAST_TAIL) -> DataFrame:
    """N10, H8. Empirical survival P(K >= k) and the fitted curve from x_min on."""
    upper = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    s = histogram.select("k", (F.sum("n_k").over(upper) / F.sum("n_k").over(Window.partitionBy())).alias("survival"))
    fit = power_law(histogram, least_tail)
    anchored = s.join(F.broadcast(fit))
    at_min = s.where(F.col("k") >= 0).join(F.broadcast(fit.select("x_min"))).where("k >= x_min").agg(F.max("survival")).scalar()
    fitted = F.when(F.col("k") >= F.col("x_min"), at_min * F.pow(F.col("k") / F.col("x_min"), -(F.col("alpha") - 1)))
    return anchored.select("k", F.round("survival", 9).alias("survival"), F.round(fitted, 9).alias("fitted"))
