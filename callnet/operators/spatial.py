"""Extensions that the documentation of the study names without code (D2-D8); their definitions are ours."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callnet.functions.scalars import DISTANCE_BANDS, band, safe_ratio
from callnet.storage import materialize

QUINTILES = ["q1", "q2", "q3", "q4", "q5"]


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def wkb_point(hexed: pd.Series) -> pd.DataFrame:
    """D2. Coordinates of a hexadecimal WKB point (with or without an SRID); null for anything else."""

    def one(text: str | None) -> tuple[float | None, float | None]:
        try:
            raw = bytes.fromhex(text or "")
            order = "<" if raw[0] == 1 else ">"
            (kind,) = struct.unpack(order + "I", raw[1:5])
            at = 9 if kind & 0x20000000 else 5
            if kind & 0xFF != 1:
                return None, None
            return struct.unpack(order + "dd", raw[at : at + 16])
        except (ValueError, IndexError, struct.error):
            return None, None

    return pd.DataFrame([one(t) for t in hexed], columns=["x", "y"])


#: Antennas that the fullest cell of the first grid may hold, and the greatest number of cells along one side.
CELL, SIDE = 64, 2.0**32
#: Coordinates beyond this have squares that overflow.
_FAR = 1e150


def nearest_antenna(points: DataFrame, antennas: DataFrame, block: int = 10_000) -> DataFrame:
    """D3. Voronoi cell membership: (point id, antenna_id) of the nearest antenna by squared distance, the smaller id on ties.

    points: (id, x, y), antennas: (antenna_id, x, y). Each place is looked up once: the places of the points meet the antennas' places in their own
    and the eight cells around it of a grid; who finds none nearer than a cell's side goes on to a grid of four times the side. The first grid is
    so fine that no cell holds more than CELL places. An unknown distance (null or NaN) is greater than any other; points and antennas whose
    coordinates are null, not finite or beyond 1e150 meet all antennas, in blocks.
    """
    points = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sites = materialize(antennas.select(F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), "antenna_id").groupBy("ax", "ay").agg(F.min("antenna_id").alias("antenna_id")), "sites")
    usual = lambda x, y: F.coalesce((F.abs(x) <= _FAR) & (F.abs(y) <= _FAR), F.lit(False))
    plain = sites.where(usual(F.col("ax"), F.col("ay")))
    has_plain = bool(plain.limit(1).count())
    places = points.select("x", "y").distinct().withColumn("plain", usual(F.col("x"), F.col("y")) if has_plain else F.lit(False))
    places = materialize(places, "places")
    found = _in_blocks(places.where("NOT plain").select("x", "y"), sites, block)
    if has_plain:
        found = found.union(_by_grids(places.where("plain").select("x", "y"), plain))
    same = points.alias("p").join(found.alias("f"), F.col("p.x").eqNullSafe(F.col("f.x")) & F.col("p.y").eqNullSafe(F.col("f.y")), "left")
    return same.groupBy("id").agg(F.min("near").alias("near")).select("id", F.col("near.antenna_id").alias("antenna_id"))


def _distance(ax: Column, ay: Column) -> Column:
    d = (ax - F.col("x")) * (ax - F.col("x")) + (ay - F.col("y")) * (ay - F.col("y"))
    return F.coalesce(d, F.lit(float("nan")))


def _in_blocks(places: DataFrame, sites: DataFrame, block: int) -> DataFrame:
    """(x, y, near): every place meets every block of some `block` antennas."""
    blocks = max(1, -(-sites.count() // block))
    dealt = sites.withColumn("block", F.pmod(F.xxhash64("antenna_id"), F.lit(blocks)))
    a = dealt.groupBy("block").agg(F.collect_list(F.struct("antenna_id", "ax", "ay")).alias("all"))
    near = F.array_min(F.transform("all", lambda p: F.struct(_distance(p["ax"], p["ay"]).alias("d"), p["antenna_id"].alias("antenna_id"))))
    return places.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(a, "block").select("x", "y", near.alias("near")).groupBy("x", "y").agg(F.min("near").alias("near"))


def _by_grids(places: DataFrame, sites: DataFrame) -> DataFrame:
    """(x, y, near) by grids of growing cells."""
    box = lambda t, x, y: t.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.lit(1))).first()
    p, s = box(places, "x", "y"), box(sites, "ax", "ay")
    if not p[4]:
        return _in_blocks(places, sites, 1)
    left, low = min(p[0], s[0]), min(p[2], s[2])
    extent = max(p[1], s[1]) - left, max(p[3], s[3]) - low
    least = max(*extent, 1e-300) / SIDE
    cell = lambda x, y, side: (F.floor((x - left) / side).alias("i"), F.floor((y - low) / side).alias("j"))
    side = max(max(s[1] - s[0], s[3] - s[2]) / s[4] ** 0.5, least)
    while side / 4 >= least and sites.groupBy(*cell(F.col("ax"), F.col("ay"), side)).count().agg(F.max("count")).first()[0] > CELL:
        side /= 4
    out, around = None, F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    while True:
        last = side > max(extent)  # all cells that exist touch each other
        a = sites.select("antenna_id", "ax", "ay", *cell(F.col("ax"), F.col("ay"), side))
        own = places.select("x", "y", *cell(F.col("x"), F.col("y"), side))
        own = own.select("x", "y", F.explode(F.transform(around, lambda k: F.col("i") + k)).alias("i"), "j").select("x", "y", "i", F.explode(F.transform(around, lambda k: F.col("j") + k)).alias("j"))
        met = own.join(a, ["i", "j"]).select("x", "y", F.struct(_distance(F.col("ax"), F.col("ay")).alias("d"), "antenna_id").alias("near"))
        best = met.groupBy("x", "y").agg(F.min("near").alias("near"))
        # a cell's side is sure to lie within the nine cells, whatever rounding did to their borders
        settled = best if last else best.where(F.col("near.d") < F.lit((side * (1 - 1e-6)) ** 2))
        settled = materialize(settled, "settled")
        out = settled if out is None else out.union(settled)
        places = materialize(places.join(settled, ["x", "y"], "left_anti"), "places")
        if last or not places.limit(1).count():
            return out
        side *= 4


def hub_antennas(hubs: DataFrame, user_antenna: DataFrame) -> DataFrame:
    """D4. Hubs (node, ..) with their antenna, null where they have none."""
    return hubs.join(user_antenna.withColumnRenamed("user_id", "node"), "node", "left")


def antenna_communities(communities: DataFrame, user_antenna: DataFrame) -> DataFrame:
    """D4. People per antenna and community. communities: (node, community)."""
    u = user_antenna.withColumnRenamed("user_id", "node")
    return communities.join(u, "node").groupBy("antenna_id", "community").agg(F.count(F.lit(1)).alias("people"))


def distance_decay(edges: DataFrame) -> DataFrame:
    """D5. Mean calls and duration per distance band that occurs."""
    g = edges.withColumn("band", band(F.col("residence_distance_km"), DISTANCE_BANDS)).where("band IS NOT NULL").groupBy("band")
    return g.agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("q_calls"), 6).alias("mean_calls"), F.round(F.avg("calls_duration_total"), 4).alias("mean_duration"))


def _quintile_calls(edges: DataFrame, residences: DataFrame, column: str) -> DataFrame:
    a = residences.select(F.col("ID").alias("id_emisor"), F.col(column).alias("q_from"))
    b = residences.select(F.col("ID").alias("id_receiver"), F.col(column).alias("q_to"))
    return edges.join(a, "id_emisor").join(b, "id_receiver").groupBy("q_from", "q_to").agg(F.sum("q_calls").alias("calls"))


def quintile_mixing(edges: DataFrame, residences: DataFrame, column: str = "residence_quintile_nation") -> DataFrame:
    """D7. Per caller's quintile the shares of its calls by callee's quintile."""
    wide = _quintile_calls(edges, residences, column).groupBy("q_from").pivot("q_to", QUINTILES).sum("calls")
    total = sum((F.coalesce(F.col(q), F.lit(0)) for q in QUINTILES), F.lit(0))
    return wide.select("q_from", *[F.round(safe_ratio(F.coalesce(F.col(q), F.lit(0)), total), 9).alias(q) for q in QUINTILES])


def quintile_homophily(edges: DataFrame, residences: DataFrame, column: str = "residence_quintile_nation") -> DataFrame:
    """D6. Observed share of calls within a quintile, and the share expected if caller and callee were independent."""
    c = _quintile_calls(edges, residences, column)
    total = c.agg(F.sum("calls")).scalar()
    out, inn = c.groupBy("q_from").agg(F.sum("calls").alias("o")), c.groupBy(F.col("q_to").alias("q_from")).agg(F.sum("calls").alias("i"))
    expected = out.join(inn, "q_from").agg(F.sum(safe_ratio(F.col("o"), total) * safe_ratio(F.col("i"), total))).scalar()
    got = c.agg(F.round(safe_ratio(F.sum(F.when(F.col("q_from") == F.col("q_to"), F.col("calls")).otherwise(0)), F.sum("calls")), 9).alias("observed"))
    return got.withColumn("expected", F.round(expected, 9))


def antenna_flow(edges_antenna: DataFrame) -> DataFrame:
    """D8. Calls and edges between antennas."""
    return edges_antenna.groupBy("emissor_antenna_id", "receptor_antenna_id").agg(F.sum("q_calls").alias("calls"), F.count(F.lit(1)).alias("edges"))
