"""Core numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callnet.operators.graph.core import Graph, degrees
from callnet.operators.profile import integer_histogram
from callnet.storage import materialize

MAX_ROUNDS = 1000


def core_numbers(g: Graph) -> DataFrame:
    """N13. (node, core). Each node's estimate, its degree at first, falls to the h-index of its neighbours' estimates until none changes (Montresor et al. 2013).

    The h-index comes from counts per (node, estimate): estimates above the node's own count as its own, so a hub's rows fold
    to as many as its core number before they are put in order.
    """
    simple = g.without_loops()
    arcs = materialize(simple.ends().select("node", "neighbour"), "arcs")
    now = materialize(degrees(simple).select("node", F.col("degree").alias("core")), "cores")
    for _ in range(MAX_ROUNDS):
        theirs = now.select(F.col("node").alias("neighbour"), F.col("core").alias("c"))
        seen = arcs.join(theirs, "neighbour").join(now, "node").groupBy("node", "core", F.least("c", "core").alias("c")).agg(F.count(F.lit(1)).alias("m"))
        at_least = F.sum("m").over(Window.partitionBy("node").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
        h = seen.withColumn("at_least", at_least).groupBy("node").agg(F.max(F.least("c", "at_least")).alias("h"))
        nxt = materialize(now.join(h, "node", "left").select("node", F.col("core").alias("before"), F.coalesce("h", F.lit(0)).cast("long").alias("core")), "cores")
        changed = nxt.where("core <> before").limit(1).count()
        now = nxt.select("node", "core")
        if not changed:
            return now
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def core_sizes(cores: DataFrame) -> DataFrame:
    """N14, H9. Nodes of core number k or more, for k = 0 to the greatest."""
    h = integer_histogram(cores, "core")
    upper = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    return h.select(F.col("value").alias("k"), F.sum("n").over(upper).alias("size"))


def nucleus(cores: DataFrame) -> DataFrame:
    """N13. Greatest core number and how many nodes have it."""
    return cores.groupBy("core").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("core")).limit(1).select(F.col("core").alias("k_max"), "size")
