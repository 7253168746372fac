"""Relational operators on small hand-made tables: edge cases that the derived tables don't hold."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from callnet.functions.ordering import ranked
from callnet.functions.scalars import call_weight, normal_key, safe_ratio
from callnet.operators import bands, edges, profile, quality, rankings, residence, spatial
from callnet.sources import tables

EMITTER = tables.EMITTERS


def emitters(spark, *rows):
    return spark.createDataFrame(list(rows), EMITTER)


def test_zip_cuts_to_the_shortest_list_and_missing_lists_give_no_rows(spark):
    e = emitters(spark, ("a", 6, 3, ["x", "y", "z"], [1, 2, 3], [1.0, 2.0, 3.0], [5.0, 6.0]), ("b", 0, 0, [], [], [], []), ("c", 1, 1, None, [1], [1.0], [1.0]))
    got = edges.explode_edges(e).orderBy("id_receiver").collect()
    assert [(r.id_emisor, r.id_receiver, r.q_calls, r.avg_duration_per_call) for r in got] == [("a", "x", 1, 5.0), ("a", "y", 2, 3.0)]
    bad = {r.id_emisor for r in quality.inconsistencies(e).collect()}
    assert bad == {"a", "c"}
    checks = quality.table_checks(e).first()
    assert (checks.receivers_agree, checks.lengths_agree, checks.totals_agree) == (False, False, True)


def test_keys_are_trimmed_of_tabs_and_null_ids_rejected(spark):
    rows = spark.createDataFrame([(" a\t", "b ", 1, 1.0, 2.0), (None, "c", 1, 1.0, 2.0), ("d", "e", 0, float("nan"), 2.0)], "id_emisor string, id_receiver string, q_calls int, residence_distance_km double, calls_duration_total double")
    got = {r.id_emisor: r for r in edges.normal_edges(rows).collect()}
    assert set(got) == {"a", "d"} and got["a"].id_receiver == "b"
    assert got["d"].avg_duration_per_call is None and got["d"].residence_distance_km is None


def test_bands_are_right_closed_and_empty_bands_stay(spark):
    e = spark.createDataFrame([("a", "b", 1, float(x), 1.0) for x in (1, 3, 3.5, 11, 12)] + [("a", "b", 1, None, 1.0)], "id_emisor string, id_receiver string, q_calls long, residence_distance_km double, calls_duration_total double")
    got = {r.label: r for r in bands.distance_bands(e).collect()}
    assert [got[k].edges for k in ("<=1", "1-3", "3-5", "5-7", "7-9", "9-11", ">11")] == [1, 1, 1, 0, 0, 1, 1]
    assert got["5-7"].median_calls is None and got["5-7"].calls == 0
    long = bands.long_shares(bands.distance_bands(e), ["edge_share", "call_share"]).count()
    assert long == 14


def test_histogram_of_a_constant_and_of_its_maximum(spark):
    one = profile.histogram(spark.range(5).select(F.lit(3).alias("x")), F.col("x"), 4).orderBy("bin").collect()
    assert [r.n for r in one] == [0, 0, 5, 0] and one[0].lower == 2.5 and one[-1].upper == 3.5
    got = profile.histogram(spark.range(11), F.col("id"), 5).orderBy("bin").collect()
    assert [r.n for r in got] == [2, 2, 2, 2, 3]
    assert profile.histogram(spark.range(0), F.col("id"), 5).count() == 0


def test_describe_skips_nulls(spark):
    got = profile.describe(spark.createDataFrame([(1,), (2,), (None,), (4,)], "x int"), ["x"]).first()
    assert (got.n, got.min, got.p50, got.max) == (3, 1.0, 2.0, 4.0)


def test_ranks_equal_a_global_window(spark):
    df = spark.range(500).select(F.expr("id % 7").alias("v"), "id")
    got = ranked(df, [F.desc("v"), F.col("id")], {"running": "v"}).orderBy("rank").collect()
    want = sorted(((r % 7, r) for r in range(500)), key=lambda x: (-x[0], x[1]))
    total = 0
    for i, ((v, r), g) in enumerate(zip(want, got, strict=True), 1):
        total += v
        assert (g.v, g.id, g.rank, g.running) == (v, r, i, total)


def test_pareto_ends_at_one_and_cuts_round_up(spark):
    e = spark.createDataFrame([(str(i), i) for i in range(1, 101)], "id_emisor string, total_calls_make long")
    last = rankings.pareto_curve(e).orderBy(F.desc("rank")).first()
    assert last.share_of_emitters == 1.0 and last.share_of_calls == 1.0
    assert {r.cut: r.n_top for r in rankings.pareto_cuts(e, (0.001, 0.07, 0.2)).collect()} == {0.001: 1, 0.07: 8, 0.2: 20}


def test_survival_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "x int, t string")
    assert sorted(r.survival for r in profile.survival_by_row(df, "x", ["t"]).collect()) == [0.333333333, 0.666666667, 1.0]
    assert {r.value: r.survival for r in profile.survival_by_value(df, "x").collect()} == {1: 1.0, 2: 0.333333333}


def test_antennas_share_the_null_geometry_and_take_the_least_id(spark):
    rows = [("2", "g", "B", "q1", "q1"), ("1", "g", "A", "q2", "q2"), ("3", None, "C", "q3", "q3"), ("4", None, "D", "q4", "q4")]
    res = spark.createDataFrame(rows, tables.RESIDENCES)
    got = {r.geometry_key: r for r in residence.antennas(res).collect()}
    assert got["<NA>"].antenna_id == 1 and got["<NA>"].residence_city == "C" and got["<NA>"].residence_geometry is None
    assert got["g"].antenna_id == 2 and got["g"].residence_city == "A"
    e = spark.createDataFrame([("1", "3", 1), ("1", "9", 1)], "id_emisor string, id_receiver string, q_calls long")
    linked = residence.edges_with_antennas(e, res).collect()
    assert [(r.emissor_antenna_id, r.receptor_antenna_id) for r in linked] == [(2, 1)]
    assert [r.ID for r in residence.missing_nodes(e, res).collect()] == ["9"]
    assert residence.duplicate_residence_ids(res).count() == 0


def test_mode_takes_the_smallest_on_ties(spark):
    ea = spark.createDataFrame([("a", "b", 5, 1), ("a", "b", 3, 2), ("a", "c", None, 2)], "id_emisor string, id_receiver string, emissor_antenna_id long, receptor_antenna_id long")
    assert {r.user_id: r.antenna_id for r in edges.user_antenna_mode(ea).collect()} == {"a": 3, "b": 1, "c": 2}


def test_scalars(spark):
    row = spark.range(1).select(safe_ratio(F.lit(1), F.lit(0)).alias("z"), normal_key(F.lit("\t x y \n")).alias("k"), call_weight(F.lit(0), F.lit(5.0)).alias("w")).first()
    assert row == Row(z=None, k="x y", w=0.0)


def test_sinks_and_scans_round_trip(spark, tmp_path):
    res = spark.createDataFrame([("1", None, "A", "q1", "q2")], tables.RESIDENCES)
    tables.write_csv(res.withColumn("helper", F.lit(1)), f"{tmp_path}/r.csv", drop=("helper",))
    assert tables.read_residences(spark, f"{tmp_path}/r.csv").collect() == res.collect()
    tables.write_parquet(res, f"{tmp_path}/r.parquet")
    assert tables.read_parquet(spark, f"{tmp_path}/r.parquet", tables.RESIDENCES).collect() == res.collect()
    assert tables.exists(spark, f"{tmp_path}/r.parquet") and not tables.exists(spark, f"{tmp_path}/none")
    assert tables.CityConfig("X", "x.parquet").path("x.parquet") == "dados/x.parquet"


def test_points_of_wkb_and_nearest_antenna(spark):
    import struct

    hexed = struct.pack("<BIdd", 1, 1, 2.5, -1.0).hex()
    got = spark.createDataFrame([(hexed,), ("zz",), (None,)], "h string").select(spatial.wkb_point("h").alias("p")).collect()
    assert got[0].p == Row(x=2.5, y=-1.0) and got[1].p.x is None and got[2].p.x is None
    ants = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "antenna_id long, x double, y double")
    points = spark.createDataFrame([("a", 4.0, 1.0), ("b", 5.0, 0.0), ("c", 9.0, 9.0)], "id string, x double, y double")
    assert {r.id: r.antenna_id for r in spatial.nearest_antenna(points, ants).collect()} == {"a": 1, "b": 1, "c": 2}
    assert {r.id: r.antenna_id for r in spatial.nearest_antenna(points, ants, block=1).collect()} == {"a": 1, "b": 1, "c": 2}  # several blocks
    assert {r.antenna_id for r in spatial.nearest_antenna(points, ants.limit(0)).collect()} == {None}


def test_nearest_antenna_meets_few_candidates_and_agrees_with_brute_force(spark, monkeypatch):
    """Even, clustered and repeated places, ties, and odd coordinates; before, every point met every antenna."""
    import math
    import random

    rng = random.Random(11)
    spot = lambda: rng.choice([(rng.uniform(0, 100), rng.uniform(0, 100)), (50 + rng.gauss(0, 0.01), 50 + rng.gauss(0, 0.01)), (rng.randrange(10) * 1.0, rng.randrange(10) * 1.0)])
    ants = [(i, *spot()) for i in range(400)] + [(400, None, 1.0), (-1, math.nan, 2.0), (-2, math.inf, 0.0)]
    points = [(i, *spot()) for i in range(600)] + [(600, 4e5, -3.0), (601, None, 1.0), (602, 50.0, 4e5)]

    def want(x, y):
        def d(a):
            v = math.nan if None in (x, y, *a[1:]) else (a[1] - x) * (a[1] - x) + (a[2] - y) * (a[2] - y)
            return (math.isnan(v), 0.0 if math.isnan(v) else v, a[0])

        return min(ants, key=d)[0]

    met = []
    monkeypatch.setattr(spatial, "_in_blocks", lambda places, *a, f=spatial._in_blocks: met.append(places.count()) or f(places, *a))
    got = spatial.nearest_antenna(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(ants, "antenna_id long, x double, y double"))
    assert {r.id: r.antenna_id for r in got.collect()} == {i: want(x, y) for i, x, y in points}
    assert met == [1]


def test_quantiles_against_sorted_lists(spark):
    import random
    from statistics import quantiles as cut

    from callnet.functions.ordering import quantiles

    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, rng.random()])) for _ in range(400)] + [("one", 7.0), ("none", None), (None, 1.0)]
    got = {r.g: r.p for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    assert set(got) == {"a", "b", "c", "one"} and got["one"] == [7.0] * 5
    for g in "abc":
        own = [v for x, v in rows if x == g and v is not None]
        assert got[g] == pytest.approx([min(own), *cut(own, n=4, method="inclusive"), max(own)])


def test_repeated_residence_ids_are_an_error(spark):
    from callnet.operators import residence

    kept = "ID string, residence_geometry string, residence_city string, residence_quintile_state string, residence_quintile_nation string"
    e = spark.createDataFrame([("1", "2", 3)], "id_emisor string, id_receiver string, q_calls long")
    homes = [("1", "g", "c", "q1", "q1"), ("2", "g", "c", "q1", "q1")]
    assert residence.edges_with_antennas(e, spark.createDataFrame(homes, kept)).count() == 1
    with pytest.raises(Exception, match="repeated residence ID"):
        residence.edges_with_antennas(e, spark.createDataFrame([*homes, ("2", "h", "c", "q1", "q1")], kept)).collect()
