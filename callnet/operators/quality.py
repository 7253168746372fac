"""Profiles and consistency checks of the caller records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callnet.functions.scalars import distinct_scalars, list_sum, safe_ratio

LISTS = ["IDs_receivers_corr", "q_calls_corr", "residence_distance_km_corr", "calls_duration_total_corr"]


def column_profile(df: DataFrame) -> DataFrame:
    """G1, A5. Per column: type, nulls, their share, distinct values (null counts as one more)."""
    per = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"), F.countDistinct(c).alias("d")) for c, t in df.dtypes]
    rows = df.agg(F.array(*per).alias("p")).select(F.inline("p"))
    return rows.select("column_name", "data_type", "n_null", F.round(safe_ratio(F.col("n_null"), F.col("n")), 6).alias("null_fraction"), (F.col("d") + (F.col("n_null") > 0).cast("long")).alias("n_distinct"))


def with_lengths(emitters: DataFrame) -> DataFrame:
    """A1, A2. List lengths and the sum of the call list."""
    return emitters.withColumns({f"len_{c}": F.array_size(c).cast("long") for c in LISTS} | {"sum_q_calls": list_sum(F.col("q_calls_corr"))})


def _equal(a: str, b: str):
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


def _same_lengths():
    # a missing list is a violation, whatever the others are
    some_null = F.lit(False)
    for c in LISTS:
        some_null = some_null | F.col(f"len_{c}").isNull()
    return (distinct_scalars(*[F.col(f"len_{c}") for c in LISTS]) == 1) & ~some_null


def table_checks(emitters: DataFrame) -> DataFrame:
    """G2. Rows, distinct ids, duplicates, and whether all rows agree with their lists."""
    e = with_lengths(emitters)
    return e.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id_emisor").alias("n_ids"), (F.count("id_emisor") - F.countDistinct("id_emisor")).alias("n_duplicate_ids"),
        F.bool_and(_equal("unique_receivers", "len_IDs_receivers_corr")).alias("receivers_agree"), F.bool_and(_same_lengths()).alias("lengths_agree"), F.bool_and(_equal("total_calls_make", "sum_q_calls")).alias("totals_agree"),
    )


def inconsistencies(emitters: DataFrame) -> DataFrame:
    """P5. Rows that contradict their lists in any of the three ways."""
    e = with_lengths(emitters)
    bad = ~_equal("unique_receivers", "len_IDs_receivers_corr") | ~_same_lengths() | ~_equal("total_calls_make", "sum_q_calls")
    return e.where(bad).select("id_emisor", "total_calls_make", "sum_q_calls", "unique_receivers", *[f"len_{c}" for c in LISTS])


def edge_reconciliation(edges: DataFrame, emitters: DataFrame) -> DataFrame:
    """G6. Edge rows, distinct ends, repeated pairs, and total calls on both sides."""
    e = edges.agg(
        F.count(F.lit(1)).alias("n_edges"), F.countDistinct("id_emisor").alias("n_emitters"), F.countDistinct("id_receiver").alias("n_receivers"),
        (F.count(F.lit(1)) - F.countDistinct(F.struct("id_emisor", "id_receiver"))).alias("n_duplicate_pairs"), F.sum("q_calls").alias("calls_in_edges"),
    )
    total = emitters.agg(F.sum("total_calls_make").alias("t")).scalar()
    return e.withColumn("calls_in_emitters", total)
