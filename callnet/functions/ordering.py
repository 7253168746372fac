"""Global ranks and running sums without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callnet.storage import materialize


def ranked(df: DataFrame, order: list[Column], running: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """df with the 1-based position by `order` (a total order) and, for each `running` {new: column}, the sum up to the row.

    Rows are dealt to ranges and written once; each range is a window of its own, and only one row of totals per
    range is summed in a single task.
    """
    running = running or {}
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in running.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ["_n", *[f"_t_{k}" for k in running]]])
    own = Window.partitionBy("_range").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "_range")
    new = {rank: F.col("_n_before") + F.row_number().over(own)}
    new |= {k: F.col(f"_t_{k}_before") + F.sum(c).over(upto) for k, c in running.items()}
    return out.withColumns(new).select(*df.columns, F.col(rank).cast("long").alias(rank), *running)


def quantiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, p): p holds the exact interpolated quantiles of the values of each `by`; nulls in either column are skipped.

    Equal values are counted first and the counts put in one global order, so no task sees the values of a group; what meets per group is the
    few rows that a wanted position falls on.
    """
    counts = df.select(F.col(by).alias(by), F.col(value).cast("double").alias("_v")).where(F.col(by).isNotNull() & F.col("_v").isNotNull()).groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = ranked(counts, [F.col(by), F.col("_v")], {"_upto": "_c"}).withColumn("_rank", F.col("_upto") - F.col("_c"))
    groups = upto.groupBy(by).agg(F.sum("_c").alias("_n"), F.min("_rank").alias("_before"))
    placed = upto.join(groups, by).withColumns({"_first": F.col("_rank") - F.col("_before"), "_last": F.col("_upto") - F.col("_before") - 1})
    ends = []
    for i, p in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(float(p))
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends.append(F.max(F.when((F.col("_first") <= place) & (place <= F.col("_last")), F.col("_v"))).alias(f"_{end}{i}"))
    got = placed.groupBy(by, "_n").agg(*ends)

    def between(i: int, p: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(float(p))
        return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))

    return got.select(by, F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("p"))
