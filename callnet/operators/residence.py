"""Matching people with residences, and the antenna dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callnet.functions.ordering import ranked
from callnet.functions.scalars import normal_key

ATTRIBUTES = ["residence_geometry", "residence_city", "residence_quintile_state", "residence_quintile_nation"]


def normal_residences(residences: DataFrame) -> DataFrame:
    """P4, P1."""
    return residences.select(normal_key(F.col("ID")).alias("ID"), *ATTRIBUTES).where("ID IS NOT NULL")


def _ids(residences: DataFrame) -> DataFrame:
    return residences.select("ID").distinct()


def missing_residence(edges: DataFrame, residences: DataFrame) -> DataFrame:
    """J3, P7, G14. Edge rows whose caller or callee has no residence: count, and per cent of the rows."""
    ids = _ids(residences).withColumn("known", F.lit(1))
    out = None
    for role, c in (("emitter", "id_emisor"), ("receiver", "id_receiver")):
        got = edges.select(F.col(c).alias("ID")).join(ids, "ID", "left").agg(F.count(F.lit(1)).alias("edge_rows"), F.count_if(F.col("known").isNull()).alias("n_missing"))
        got = got.select(F.lit(role).alias("role"), "edge_rows", "n_missing", F.round(F.try_divide(100.0 * F.col("n_missing"), F.col("edge_rows")), 6).alias("percent_missing"))
        out = got if out is None else out.unionByName(got)
    return out


def edge_people(edges: DataFrame) -> DataFrame:
    """U1, A6. Distinct ids of both ends."""
    return edges.select(F.col("id_emisor").alias("ID")).union(edges.select("id_receiver")).distinct()


def missing_nodes(edges: DataFrame, residences: DataFrame) -> DataFrame:
    """J2, U2. People in edges without a residence."""
    return edge_people(edges).join(_ids(residences), "ID", "left_anti")


def raw_multidegree(edges: DataFrame) -> DataFrame:
    """N24, J4, G12. Rows as caller plus rows as callee, per person."""
    both = edges.select(F.col("id_emisor").alias("ID")).union(edges.select("id_receiver"))
    return both.groupBy("ID").agg(F.count(F.lit(1)).alias("degree"))


def missing_multidegree(edges: DataFrame, residences: DataFrame) -> DataFrame:
    """J5. The multidegree of people without a residence."""
    return missing_nodes(edges, residences).join(raw_multidegree(edges), "ID", "left")


def antennas(residences: DataFrame) -> DataFrame:
    """W5, P11, G19. One row per geometry (all null geometries share one): dense key by geometry, attributes of the least ID."""
    rows = residences.withColumn("geometry_key", F.coalesce("residence_geometry", F.lit("<NA>")))
    first = rows.groupBy("geometry_key").agg(F.min_by(F.struct(*ATTRIBUTES), F.col("ID")).alias("a"))
    return ranked(first, [F.col("geometry_key")], rank="antenna_id").select("antenna_id", "geometry_key", "a.*")


def antennas_of_city(antenna_table: DataFrame, city: str) -> DataFrame:
    """P6."""
    return antenna_table.where(F.col("residence_city") == F.lit(city))


def edges_with_antennas(edges: DataFrame, residences: DataFrame) -> DataFrame:
    """J1, P8, J6, P16. Edges of which both ends have a residence, with the antenna of either end. A repeated residence ID is an error, as it would multiply edges."""
    keys = residences.withColumn("geometry_key", F.coalesce("residence_geometry", F.lit("<NA>"))).join(antennas(residences).select("geometry_key", "antenna_id"), "geometry_key").groupBy("ID").agg(F.count(F.lit(1)).alias("n"), F.min("antenna_id").alias("antenna_id"))
    keys = keys.select("ID", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated residence ID "), "ID")).cast("long")).otherwise(F.col("antenna_id")).alias("antenna_id"))
    a = keys.select(F.col("ID").alias("id_emisor"), F.col("antenna_id").alias("emissor_antenna_id"))
    b = keys.select(F.col("ID").alias("id_receiver"), F.col("antenna_id").alias("receptor_antenna_id"))
    # an inner join on a unique key keeps the rows that both semi joins keep, and looks the key up in the same pass
    return edges.join(a, "id_emisor").join(b, "id_receiver").select(*edges.columns, "emissor_antenna_id", "receptor_antenna_id")


def duplicate_residence_ids(residences: DataFrame) -> DataFrame:
    """J6's precondition: ids that occur more than once."""
    return residences.groupBy("ID").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def antenna_nulls(edges_antenna: DataFrame) -> DataFrame:
    """G15."""
    return edges_antenna.agg(F.count_if(F.col("emissor_antenna_id").isNull()).alias("emissor_nulls"), F.count_if(F.col("receptor_antenna_id").isNull()).alias("receptor_nulls"))
