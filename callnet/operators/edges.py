"""From list columns to edges to undirected weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callnet.functions.scalars import call_weight, nan_to_null, normal_key, safe_ratio
from callnet.operators.quality import LISTS


def explode_edges(emitters: DataFrame) -> DataFrame:
    """A4. One row per list position; lists are cut to the shortest, a missing list gives no rows."""
    n = F.least(*[F.array_size(c) for c in LISTS])
    zipped = F.arrays_zip(*[F.slice(c, F.lit(1), n) for c in LISTS])
    rows = emitters.select("id_emisor", zipped.alias("z")).select("id_emisor", F.inline("z").alias("id_receiver", "q_calls", "residence_distance_km", "calls_duration_total"))
    return normal_edges(rows)


def normal_edges(rows: DataFrame) -> DataFrame:
    """P4. Trimmed text ids, NaN as null, rows without an id rejected, duration per call added."""
    rows = rows.select(normal_key(F.col("id_emisor")).alias("id_emisor"), normal_key(F.col("id_receiver")).alias("id_receiver"), F.col("q_calls").cast("long").alias("q_calls"), *[nan_to_null(F.col(c)).alias(c) for c in ("residence_distance_km", "calls_duration_total")])
    rows = rows.where("id_emisor IS NOT NULL AND id_receiver IS NOT NULL")
    return rows.withColumn("avg_duration_per_call", safe_ratio(F.col("calls_duration_total"), F.col("q_calls")))


def undirected_edges(edges: DataFrame) -> DataFrame:
    """P14, G10, P15. Both directions of a pair as one: sums, the mean of the directions' means, and the weight."""
    e = edges.where("id_emisor IS NOT NULL AND id_receiver IS NOT NULL")  # least and greatest skip nulls: a null end would make a loop
    g = e.groupBy(F.least("id_emisor", "id_receiver").alias("source"), F.greatest("id_emisor", "id_receiver").alias("target"))
    out = g.agg(F.sum("q_calls").alias("q_calls"), F.sum("calls_duration_total").alias("calls_duration_total"), F.avg("avg_duration_per_call").alias("avg_duration_per_call"), F.avg("residence_distance_km").alias("residence_distance_km"))
    return out.withColumn("weight", call_weight(F.col("q_calls"), F.col("calls_duration_total")))


def user_antenna_mode(edges_antenna: DataFrame) -> DataFrame:
    """U3, P9, P12, G11. Most frequent antenna of each person over both roles, the smallest on ties."""
    a = edges_antenna.select(F.col("id_emisor").alias("user_id"), F.col("emissor_antenna_id").alias("antenna_id"))
    b = edges_antenna.select(F.col("id_receiver").alias("user_id"), F.col("receptor_antenna_id").alias("antenna_id"))
    return a.unionByName(b).dropna(how="any").groupBy("user_id").agg(F.mode("antenna_id", True).alias("antenna_id"))
