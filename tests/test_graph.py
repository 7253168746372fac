"""Graph operators against closed forms and brute force."""

import random
from collections import deque
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from callnet.operators.graph import centrality, clustering, community, core, kcore, packed, paths, powerlaw, random_graph, robustness


def graph(spark, pairs, self_loops="keep"):
    rows = [(str(a), str(b), 1, 1.0) for a, b in pairs]
    return core.Graph.from_edges(spark.createDataFrame(rows, "source string, target string, q_calls long, weight double"), self_loops)


def values(df, key="node", value=None):
    return {r[key]: r[value or df.columns[1]] for r in df.collect()}


def random_pairs(n, m, seed):
    return sorted(random.Random(seed).sample(list(combinations(range(n), 2)), m))


def distances(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        out[s], queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in out[s]:
                    out[s][y] = out[s][x] + 1
                    queue.append(y)
    return near, out


def test_loops_count_twice_and_stay_nodes_when_dropped(spark):
    g = graph(spark, [(1, 1), (1, 2)])
    assert values(core.degrees(g)) == {"1": 3, "2": 1}
    h = graph(spark, [(1, 2), (3, 3)], "drop")
    assert values(core.degrees(h)) == {"1": 1, "2": 1, "3": 0}
    assert core.counts(h).first().density == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        graph(spark, [(1, 2)], "maybe")


def test_components_of_a_long_path_and_an_isolated_pair(spark):
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")]
    g = graph(spark, pairs)
    found = values(core.components(g))
    assert {found[f"{i:03d}"] for i in range(61)} == {"000"} and found["y"] == "x" and found["z"] == "z"
    share = core.giant_share(core.components(g)).first()
    assert (share.n_components, share.giant_size) == (3, 61)
    assert core.giant(g).vertices.count() == 61


def test_clustering_against_brute_force(spark):
    pairs = random_pairs(25, 90, 1)
    near, _ = distances(pairs)
    got = values(clustering.local_clustering(graph(spark, [*pairs, (3, 3)])), value="clustering")
    for v, ns in near.items():
        links = sum(1 for a, b in combinations(ns, 2) if b in near[a])
        assert got[str(v)] == pytest.approx(2 * links / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else 0)
    star = clustering.average_clustering(graph(spark, [(0, i) for i in range(1, 5)])).first()[0]
    full = clustering.average_clustering(graph(spark, combinations(range(5), 2))).first()[0]
    assert (star, full) == (0.0, 1.0)


def test_core_numbers_against_peeling(spark):
    pairs = random_pairs(30, 80, 2)
    near, _ = distances(pairs)
    left, want, k = {v: set(n) for v, n in near.items()}, {}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        want[str(v)] = k
        for u in left.pop(v):
            left[u].discard(v)
    cores = kcore.core_numbers(graph(spark, pairs))
    assert values(cores) == want
    sizes = {r.k: r["size"] for r in kcore.core_sizes(cores).collect()}
    assert sizes == {j: sum(c >= j for c in want.values()) for j in range(max(want.values()) + 1)}
    assert kcore.nucleus(cores).first().k_max == max(want.values())


def test_paths_and_betweenness_against_brute_force(spark):
    pairs = random_pairs(12, 18, 3)
    g = core.giant(graph(spark, pairs))
    inside = {r.node for r in g.vertices.collect()}
    pairs = [(a, b) for a, b in pairs if str(a) in inside]
    near, dist = distances(pairs)
    total = sum(d for ds in dist.values() for d in ds.values())
    row = paths.mean_path_length(g, k=None).first()
    assert row.distance == total and row.pairs == len(near) * (len(near) - 1)
    n = len(near)
    count = {s: {s: 1} for s in near}
    for s in near:
        for x in sorted(dist[s], key=dist[s].get):
            if x != s:
                count[s][x] = sum(count[s][y] for y in near[x] if dist[s][y] == dist[s][x] - 1)
    want = {str(v): sum(count[s][v] * count[v][t] / count[s][t] for s in near for t in near if len({s, t, v}) == 3 and dist[s][v] + dist[v][t] == dist[s][t]) / ((n - 1) * (n - 2)) for v in near}
    got = values(paths.betweenness(g, k=None))
    assert got == pytest.approx(want)


def test_searches_in_tasks_and_by_joins_agree(spark, monkeypatch):
    """Both ways, from all and from some sources, in stretches of a few arcs, with an isolated pair and a loop."""
    pairs = [*random_pairs(60, 120, 6), ("x", "y"), (3, 3), *[(70, i) for i in range(40)]]
    g = graph(spark, pairs).materialized()
    monkeypatch.setattr(packed, "STRETCH", 16)
    lists = packed.Lists(3, [[np.array(x, np.int32).tobytes() for x in ([0, 1, 2], [1, 2, 1], [1, 0, 2, 1])]])
    assert packed.distances(lists, np.array([0, 1, 2])) == (8, 6) and packed.dependencies(lists, np.array([0, 1, 2])).tolist() == [0.0, 2.0, 0.0]
    for k in (None, 7, 500):
        assert paths.mean_path_length(g, k).first() == paths.mean_path_by_joins(g, k).first()
        want = values(paths.dependencies_by_joins(g, k))
        got = values(packed.dependency_sums(packed.packed(g), paths.sample_nodes(g, k), k))
        assert {v: x for v, x in got.items() if x > 1e-9} == pytest.approx({v: x for v, x in want.items() if x > 1e-9})
    assert values(paths.betweenness(graph(spark, [(1, 1)]))) == {"1": 0.0}


def test_500_sources_on_a_large_graph_need_no_row_per_source_and_node(spark, monkeypatch):
    """By joins, 500 sources on 3000 nodes wrote tables of 1.5 million rows in all."""
    monkeypatch.setattr(paths, "levels", None)
    g = graph(spark, random_pairs(3000, 9000, 8)).materialized()
    assert paths.mean_path_length(g).first().pairs > 500 * 2000
    assert paths.betweenness(g).where("betweenness > 0").count() > 2000


def test_eigenvector_of_a_star(spark):
    got = values(centrality.eigenvector(graph(spark, [(0, i) for i in range(1, 5)])))
    assert got["0"] == pytest.approx(2**-0.5, abs=1e-4) and got["1"] == pytest.approx(8**-0.5, abs=1e-4)
    with pytest.raises(RuntimeError):
        centrality.eigenvector(graph(spark, [(0, i) for i in range(1, 5)]), max_steps=2)


def test_eigenvector_in_a_task_and_by_joins_agree(spark, monkeypatch):
    """With loops, weights, a component apart and a null weight; the task writes no table a step."""
    rows = [(a, b, 1.0 + a % 5) for a, b in random_pairs(60, 120, 6)]
    rows = [(str(a), str(b), w) for a, b, w in [*rows, (3, 3, 2.5), (70, 71, 4.0), (71, 72, None)]]
    g = core.Graph.from_edges(spark.createDataFrame(rows, "source string, target string, weight double")).materialized()
    big = core.giant(g).materialized()
    assert big.inside is not None and big.edges.where("source IN ('70', '71')").count() == 0
    want = [values(centrality.eigenvector_by_joins(x)) for x in (g, big)]
    monkeypatch.setattr(centrality, "eigenvector_by_joins", None)
    for x, expected in zip((g, big), want, strict=True):
        assert values(centrality.eigenvector(x)) == pytest.approx(expected, abs=1e-9)


def test_components_in_a_task_against_a_search(spark):
    """A path whose numbers jump, a star, a loop alone and random pieces; labels are least numbers."""
    pairs = [*[((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], *[(200, 201 + i) for i in range(9)], (300, 300), *[(400 + a, 400 + b) for a, b in random_pairs(80, 60, 5)]]
    g = graph(spark, pairs).materialized()
    p = packed.packed(g)
    got = packed.component_numbers(p).join(p.numbers, "i").select("node", "component")
    names = {r.i: r.node for r in p.numbers.collect()}
    assert {r.node: names[r.component] for r in got.collect()} == values(core.components(g))
    assert {r.node for r in core.giant(g).vertices.collect()} == {str(i) for i in range(101)}


def test_assortativity_is_null_on_regular_graphs(spark):
    assert core.assortativity(graph(spark, [(0, 1), (1, 2), (2, 0)])).first()[0] is None
    assert core.assortativity(graph(spark, [(0, 1), (1, 2)])).first()[0] == pytest.approx(-1)


def test_power_law_against_its_definition(spark):
    """Exponent and distance of a start m are, by definition, 1 + N / sum(n_k ln(k / (m - 1/2))) over degrees k >= m, and the
    greatest difference between the steps of the tail's distribution and 1 - (k / m) ** (1 - exponent); the start of least distance is chosen."""
    from collections import Counter
    from math import log

    import numpy as np

    n = Counter(np.minimum(np.random.default_rng(4).zipf(2.3, 400), 40).tolist())

    def size(m):
        return sum(c for k, c in n.items() if k >= m)

    def exponent(m):
        return 1 + size(m) / sum(c * log(k / (m - 0.5)) for k, c in n.items() if k >= m)

    def distance(m):
        steps = [(k, s / size(m)) for k in n if k >= m for s in (size(m) - size(k) + 1, size(m) - size(k + 1))]
        return max(abs(share - 1 + (k / m) ** (1 - exponent(m))) for k, share in steps)

    starts = [m for m in range(1, max(n)) if size(m) >= 30]
    m = min(starts, key=distance)
    h = spark.createDataFrame(list(n.items()), "k long, n_k long")
    got = powerlaw.power_law(h).first()
    assert (got.x_min, got.n_tail) == (m, size(m)) and got.alpha == pytest.approx(exponent(m)) and got.ks == pytest.approx(distance(m))
    assert powerlaw.power_law(h.limit(0)).count() == 0
    # two degrees, by hand: 40 nodes of degree 1 and 40 of degree 2 from 1 on
    two = powerlaw.power_law(spark.createDataFrame([(1, 40), (2, 40)], "k long, n_k long")).first()
    assert (two.x_min, two.n_tail) == (1, 80) and two.alpha == pytest.approx(1 + 80 / (40 * log(2) + 40 * log(4)))


def test_two_cliques_are_two_communities(spark):
    pairs = [*combinations(range(6), 2), *combinations(range(6, 12), 2), (0, 6)]
    g = graph(spark, pairs)
    found = community.louvain(g)
    got = values(found)
    assert len({got[str(i)] for i in range(6)}) == 1 and len(set(got.values())) == 2
    q = community.modularity(g, found).first()[0]
    assert q == pytest.approx(30 / 31 - 2 * (31 / 62) ** 2)
    table = community.community_table(found).collect()
    assert {(r.community_size, r.community_rank) for r in table} == {(6, 1), (6, 2)}


def test_louvain_moves_need_no_join_and_score_like_those_by_joins(spark, monkeypatch):
    """30 groups of 12 with few ties between them and a loop; before, every sweep was a plan of joins."""
    rng = random.Random(9)
    pairs = [(f"{b:02d}{i:02d}", f"{b:02d}{j:02d}") for b in range(30) for i, j in combinations(range(12), 2) if rng.random() < 0.7]
    pairs += [(f"{b:02d}00", f"{(b + 1) % 30:02d}05") for b in range(30)] + [("0003", "0003")]
    g = graph(spark, pairs).materialized()
    want = community.modularity(g, community.louvain_by_joins(g)).first()[0]
    monkeypatch.setattr(community, "_sweep", None)
    found = community.louvain(g)
    assert community.modularity(g, found).first()[0] >= want - 0.002
    assert found.count() == g.vertices.count() and values(found) == values(community.louvain(g))
    assert all(len(set(v for n, v in values(found).items() if n[:2] == f"{b:02d}")) == 1 for b in range(30))
    nothing = community.louvain(core.Graph(g.vertices.limit(3).localCheckpoint(), g.edges.limit(0)))
    assert sorted(values(nothing).values()) == [0, 1, 2]


def test_one_sweep_against_its_definition():
    """Gains of every neighbouring community, one by one."""
    rng = np.random.default_rng(3)
    w = np.triu(rng.integers(0, 4, (12, 12)), 1).astype(float)
    w += w.T
    k, labels = w.sum(axis=0), rng.integers(0, 5, 12).astype(np.int32)
    m, totals = w.sum() / 2, np.bincount(labels, k, minlength=12)
    own, to = np.nonzero(w)
    moved, where = community._best(np.arange(12), own, to, w[own, to], labels, totals, k, m)
    got = dict(zip(moved.tolist(), where.tolist(), strict=True))
    for v in range(12):
        gain = {c: w[v][labels == c].sum() - k[v] * (totals[c] - k[v] * (c == labels[v])) / (2 * m) for c in {labels[v], *labels[w[v] > 0]}}
        best = max(gain, key=lambda c: (gain[c], c))
        assert got.get(v) == (best if gain[best] > gain[labels[v]] + 1e-12 else None)


def test_random_graph_has_exactly_its_edges(spark):
    g = random_graph.gnm(spark, 40, 100)
    rows = g.edges.collect()
    assert len({(r.source, r.target) for r in rows}) == len(rows) == 100 and all(r.source < r.target for r in rows)
    assert random_graph.gnm(spark, 5, 99).edges.count() == 10


def test_small_world_releases_the_disk_of_each_part(spark, monkeypatch):
    """Every part ends before the next begins, written tables are not written again; before, one plan held the shuffle files of all four."""
    g = graph(spark, [(i, (i + s) % 60) for i in range(60) for s in (1, 2)]).materialized()
    assert g.materialized().edges is g.edges
    calls = []
    monkeypatch.setattr(random_graph, "release", lambda s: calls.append(s))
    row = random_graph.small_world(g).first()
    assert len(calls) == 5 and row.c == pytest.approx(0.5) and row.l == pytest.approx(sum(-(-d // 2) for d in [min(j, 60 - j) for j in range(1, 60)]) / 59)
    assert row.sigma == pytest.approx(row.c / row.c_random / (row.l / row.l_random))


def test_robustness_against_brute_force(spark):
    pairs = random_pairs(20, 30, 5)
    g = core.giant(graph(spark, pairs)).materialized()
    nodes = [r.node for r in g.vertices.collect()]
    inner = [(str(a), str(b)) for a, b in pairs if str(a) in nodes]
    order = robustness.attack_order(g)
    removal = values(order)
    assert sorted(removal.values()) == list(range(1, len(nodes) + 1))
    got = {r.step: r.giant_fraction for r in robustness.giant_fraction_curve(g, order, steps=5).collect()}
    for step in range(5):
        cut = int(0.6 * step / 4 * len(nodes))
        alive = {v for v in nodes if removal[v] > cut}
        _, dist = distances([(a, b) for a, b in inner if a in alive and b in alive])
        assert got[step] == pytest.approx(max([len(d) for d in dist.values()], default=min(1, len(alive))) / len(nodes))
    assert got[0] == 1.0
