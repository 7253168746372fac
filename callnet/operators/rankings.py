"""Top rows, Pareto curve, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callnet.functions.ordering import ranked
from callnet.functions.scalars import safe_ratio


def top(df: DataFrame, by: list[str], tie: list[str], n: int = 15) -> DataFrame:
    """T1-T6. The n rows of greatest `by`; `tie` makes the order total."""
    return df.orderBy(*[F.desc(c) for c in by], *tie).limit(n)


def pareto_curve(emitters: DataFrame) -> DataFrame:
    """W1-W3, H5. Callers by descending calls: rank, share of callers, share of calls up to them."""
    e = emitters.select("id_emisor", "total_calls_make")
    sums = e.agg(F.count(F.lit(1)).alias("n"), F.sum("total_calls_make").alias("total"))
    got = ranked(e, [F.desc("total_calls_make"), F.col("id_emisor")], {"running": "total_calls_make"})
    got = got.join(F.broadcast(sums))
    return got.select("id_emisor", "total_calls_make", "rank", F.round(F.col("rank") / F.col("n"), 9).alias("share_of_emitters"), F.round(safe_ratio(F.col("running"), F.col("total")), 9).alias("share_of_calls"))


def pareto_cuts(emitters: DataFrame, cuts: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """T7. Share of all calls made by the first max(1, ceil(cut * n)) callers."""
    e = emitters.select("id_emisor", "total_calls_make")
    n_total = e.agg(F.count(F.lit(1)).alias("n"), F.sum("total_calls_make").alias("total"))
    got = ranked(e, [F.desc("total_calls_make"), F.col("id_emisor")])
    table = n_total.select("n", "total", F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut"))
    table = table.withColumn("n_top", F.greatest(F.lit(1), F.ceil(F.col("cut") * F.col("n").cast("double"))).cast("long"))
    joined = F.broadcast(table).join(got, F.col("rank") <= F.col("n_top"))
    return joined.groupBy("cut", "n_top").agg(F.round(safe_ratio(F.sum("total_calls_make"), F.first("total")), 9).alias("share_of_calls"))


def concentration(edges: DataFrame) -> DataFrame:
    """G9, P3. Per caller: calls, receivers, greatest single receiver, and the ratios."""
    g = edges.groupBy("id_emisor").agg(F.sum("q_calls").alias("calls"), F.countDistinct("id_receiver").alias("receivers"), F.max("q_calls").alias("top_calls"))
    return g.withColumns({"top_share": F.round(safe_ratio(F.col("top_calls"), F.col("calls")), 9), "calls_per_receiver": F.round(safe_ratio(F.col("calls"), F.col("receivers")), 9)})
