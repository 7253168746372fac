"""Connected components by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from callnet.storage import discard, materialize

MAX_ROUNDS = 60


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The edges, materialized, and a checksum that the same write takes."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), name)
    return out, (int(seen.get["n"]), int(seen.get["x"] or 0))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, label) for every endpoint of `edges` (two columns, any names): label is the least id reachable.

    Loops and repeated edges are allowed; edges with a null end are ignored. The work per round is two joins whose
    sides shrink to a star per component; rounds grow with the logarithm of the longest path.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    pairs = materialize(pairs.distinct(), "edges")
    stars, before = _written(_small_star(_large_star(pairs.where("u <> v"))), "stars")
    for _ in range(MAX_ROUNDS):
        last = stars
        stars, now = _written(_small_star(_large_star(last)), "stars")
        discard(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    return ids.join(stars.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
