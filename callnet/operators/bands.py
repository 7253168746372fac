"""Bands of distance and of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callnet.functions.ordering import quantiles
from callnet.functions.scalars import CALL_BANDS, DISTANCE_BANDS, band, safe_ratio


def _axis(df: DataFrame, bands: list[tuple[float | None, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, label) for i, (_, label) in enumerate(bands)], "band int, label string")


def _shares(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """W4. Each column's share of its total; the window sees one row per band."""
    everything = Window.partitionBy()
    return df.withColumns({new: F.round(safe_ratio(F.col(c), F.sum(c).over(everything)), 9) for new, c in columns.items()})


def distance_bands(edges: DataFrame) -> DataFrame:
    """R1, G7, W4. Edges, calls, duration, median and mean calls per distance band, empty bands included."""
    banded = edges.withColumn("band", band(F.col("residence_distance_km"), DISTANCE_BANDS))
    got = banded.groupBy("band").agg(F.count(F.lit(1)).alias("e"), F.sum("q_calls").alias("c"), F.sum("calls_duration_total").alias("d"), F.round(F.avg("q_calls"), 6).alias("mean_calls"))
    medians = quantiles(banded, "band", "q_calls", (0.5,)).select("band", F.col("p")[0].alias("median_calls"))
    out = _axis(edges, DISTANCE_BANDS).join(got, "band", "left").join(medians, "band", "left")
    out = out.select("band", "label", F.coalesce("e", F.lit(0)).alias("edges"), F.coalesce("c", F.lit(0)).alias("calls"), F.round(F.coalesce("d", F.lit(0.0)), 2).alias("duration"), "median_calls", "mean_calls")
    return _shares(out, {"edge_share": "edges", "call_share": "calls"})


def caller_bands(emitters: DataFrame) -> DataFrame:
    """R2, G8, W4. Callers, calls and median receivers per band of calls made."""
    banded = emitters.withColumn("band", band(F.col("total_calls_make"), CALL_BANDS))
    got = banded.groupBy("band").agg(F.count(F.lit(1)).alias("e"), F.sum("total_calls_make").alias("c"))
    medians = quantiles(banded, "band", "unique_receivers", (0.5,)).select("band", F.col("p")[0].alias("median_receivers"))
    out = _axis(emitters, CALL_BANDS).join(got, "band", "left").join(medians, "band", "left").select("band", "label", F.coalesce("e", F.lit(0)).alias("emitters"), F.coalesce("c", F.lit(0)).alias("calls"), "median_receivers")
    return _shares(out, {"emitter_share": "emitters", "call_share": "calls"})


def long_shares(banded: DataFrame, shares: list[str]) -> DataFrame:
    """R3, H7. One row per band and share."""
    return banded.unpivot(["band", "label"], shares, "metric", "share")
