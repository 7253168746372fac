"""The pairs that path_length searches: as those of the call tables, and as a graph of its own."""

import pytest
from pyspark.sql import functions as F

from callnet.operators import edges
from callnet.operators.graph import core, packed, paths
from callnet.plans import queries
from callnet.sources import fixtures

DIR = "/root/testdata/sf0.001"


def pairs_of(df):
    return {(min(r), max(r)) for r in df.select("source", "target").collect()}


def write(spark, path, customers, orders, lines):
    spark.createDataFrame([(x,) for x in customers], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    rows = [(*line, 10.0, 0.01, 0.02) for line in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


#: null keys, lines without an order, an order key twice, an order without a caller, negative keys, long-range ties into and out of the block, loops
ORDERS = [(1, 5), (2, 31), (3, 64), (3, 95), (4, None), (None, 7), (5, -40), (6, 0), (7, 12)]
LINES = [
    *[(o, p, p * 3, k) for o in range(1, 9) for p in (0, 1, 3, 8, 16, 29, 64, -8, -5) for k in (1, 6, 7)], (1, None, 4, 7), (1, None, 4, 1), (2, 8, None, 7), (2, 7, None, 7), (3, 16, 5, None), (None, 8, 1, 6), (9, 40, 2, 7),
]


def test_ties_are_the_pairs_of_the_call_table(spark, tmp_path):
    for i, at in enumerate([DIR, write(spark, tmp_path / "a", range(100), ORDERS, LINES)]):
        whole = edges.undirected_edges(fixtures.edges(spark, at, "dense")).select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))
        want = pairs_of(whole)
        assert pairs_of(fixtures.ties(spark, at)) == want and len(want) > 10, i
    # without customers there is nobody to call far away
    near = pairs_of(fixtures.ties(spark, write(spark, tmp_path / "b", [], ORDERS, LINES)))
    assert near and near <= pairs_of(fixtures.ties(spark, at))


def ties(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "source long, target long")


def both(spark, pairs):
    """The graph as it is from text and weights."""
    rows = sorted({(min(str(a), str(b)), max(str(a), str(b))) for a, b in pairs})
    return core.giant(core.Graph.from_edges(spark.createDataFrame([(*r, 1.0) for r in rows], "source string, target string, weight double")))


#: two components of 6 nodes, of which the one of greater numbers has the lesser text; one of 5; a loop alone; pairs in both directions and twice
PAIRS = [(9, 20), (20, 21), (21, 22), (22, 23), (23, 9), (9, 9), (9, 24), (100, 50), (50, 51), (51, 52), (52, 53), (53, 100), (100, 54), (54, 100), (54, 100), (7, 7), (70, 71), (71, 72), (72, 73), (73, 74), (1 << 40, -3)]


@pytest.mark.parametrize("limit", [None, "nodes", "arcs"])
def test_giant_of_ties_is_the_giant(spark, monkeypatch, limit):
    monkeypatch.setattr(packed, "STRETCH", 4)
    if limit:
        monkeypatch.setattr(packed, "MAX_NODES" if limit == "nodes" else "MAX_ARCS", 8)
    g, want = core.giant_of_ties(ties(spark, PAIRS)), both(spark, PAIRS)
    assert (g.inside is None) == (limit is not None)
    assert {str(r.node) for r in g.vertices.collect()} == {r.node for r in want.vertices.collect()} == {"100", "50", "51", "52", "53", "54"}
    assert {frozenset(map(str, r)) for r in g.edges.select("source", "target").collect()} == {frozenset(r) for r in want.without_loops().edges.select("source", "target").collect()}
    for k in (None, 3, 500) if limit is None else (3,):
        assert paths.mean_path_length(g, k).first() == paths.mean_path_length(want, k).first()


def test_giant_of_no_ties_and_of_loops_alone(spark):
    for pairs, n in (([], 0), ([(4, 4), (30, 30)], 1)):
        g = core.giant_of_ties(ties(spark, pairs))
        assert [r.node for r in g.vertices.collect()] == [30][:n]
        assert paths.mean_path_length(g).first().asDict() == {"distance": 0, "pairs": 0, "mean_path": None}


def test_path_length_needs_no_sums_of_calls(spark, monkeypatch, tmp_path):
    """It derived the whole weighted table, with its text ids sorted and joined, to count steps."""
    at = write(spark, tmp_path / "a", range(100), ORDERS, LINES)
    want = [paths.mean_path_length(queries.dense_component(spark, d)).first() for d in (DIR, at)]
    monkeypatch.setattr(queries, "dense_graph", None)
    monkeypatch.setattr(fixtures, "edges", None)
    assert [queries.path_length(spark, d).first() for d in (DIR, at)] == want
