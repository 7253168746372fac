"""Schemas, scans and sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


EMITTERS = _schema(
    id_emisor=_S, total_calls_make=_L, unique_receivers=_L, IDs_receivers_corr=T.ArrayType(_S), q_calls_corr=T.ArrayType(_L), residence_distance_km_corr=T.ArrayType(_D), calls_duration_total_corr=T.ArrayType(_D)
)
EDGES = _schema(id_emisor=_S, id_receiver=_S, q_calls=_L, residence_distance_km=_D, calls_duration_total=_D, avg_duration_per_call=_D)
RESIDENCES = _schema(ID=_S, residence_geometry=_S, residence_city=_S, residence_quintile_state=_S, residence_quintile_nation=_S)
ANTENNAS = _schema(antenna_id=_L, residence_geometry=_S, residence_city=_S, residence_quintile_state=_S, residence_quintile_nation=_S)
EDGES_ANTENNA = T.StructType([*EDGES.fields, T.StructField("emissor_antenna_id", _L), T.StructField("receptor_antenna_id", _L)])


@dataclass(frozen=True)
class CityConfig:
    """S1. Where the tables of one city are."""

    city: str
    emitters_file: str
    data_dir: str = "dados"
    residences_file: str = "residences.csv"

    def path(self, name: str) -> str:
        return f"{self.data_dir.rstrip('/')}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    """S2. Whether a path exists, in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """(modification time, length in bytes) of a file or folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(hadoop).getModificationTime(), fs.getContentSummary(hadoop).getLength()


def reload(spark: SparkSession, path: str, schema: T.StructType, build: Callable[[], DataFrame]) -> DataFrame:
    """S10. What is at `path` if a write of it has ended; otherwise it is built and written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        write_parquet(build(), path)
    return read_parquet(spark, path, schema)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S4, S5. A declared schema: no inference, and stray index columns of other writers are not read."""
    return spark.read.schema(schema).parquet(path)


def read_residences(spark: SparkSession, path: str) -> DataFrame:
    """S6. CSV with a header, parsed against the schema; a malformed line fails the read."""
    return spark.read.schema(RESIDENCES).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """S7, P13. CSV with a header and without helper columns."""
    df.drop(*drop).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """S8, S9. Parquet without index columns."""
    df.write.mode("overwrite").parquet(path)


def table_info(df: DataFrame) -> DataFrame:
    """S13. column_name, data_type, n_present for every column, in one pass."""
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = counted.unpivot([], df.columns, "column_name", "n_present")
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return long.select("column_name", kinds[F.col("column_name")].alias("data_type"), F.col("n_present").cast("long").alias("n_present"))


def table_shape(df: DataFrame) -> DataFrame:
    """S3, S14. n_rows, n_columns; Parquet answers the count from its footers."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def preview(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """S12. The first n rows by a total order."""
    return df.orderBy(*by).limit(n)
