"""Communities and modularity."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callnet.functions.ordering import ranked
from callnet.functions.scalars import safe_ratio
from callnet.operators.graph.core import Graph
from callnet.operators.graph.packed import blocks_of, fits, packed
from callnet.storage import discard, materialize

LEAST_GAIN, MAX_LEVELS = 1e-7, 30
#: Sweeps after which the gain is looked at.
SWEEPS = 8


def modularity(g: Graph, partition: DataFrame, weight: str = "weight") -> DataFrame:
    """N21. Sum over communities of L / m - (K / 2m)^2; a loop counts once in L and twice in K. partition: (node, community)."""
    e = g.edges.select("source", "target", F.col(weight).alias("w"))
    a = partition.select(F.col("node").alias("source"), F.col("community").alias("cs"))
    b = partition.select(F.col("node").alias("target"), F.col("community").alias("ct"))
    e = e.join(a, "source").join(b, "target")
    sides = e.select(F.col("cs").alias("community"), F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0.0).alias("l"), F.col("w").alias("k")).union(e.select("ct", F.lit(0.0), "w"))
    per = sides.groupBy("community").agg(F.sum("l").alias("l"), F.sum("k").alias("k"))
    m = e.agg(F.sum("w")).scalar()
    share = safe_ratio(F.col("k"), 2 * m)
    return per.agg(F.sum(safe_ratio(F.col("l"), m) - share * share).alias("modularity"))


def _score(arcs: DataFrame, labels: DataFrame, loops: DataFrame, m: float) -> float:
    """Modularity of labels (node, c) on arcs (node, neighbour, w; both directions) with loops (node, w)."""
    there = labels.select(F.col("node").alias("neighbour"), F.col("c").alias("d"))
    inner = arcs.join(labels, "node").join(there, "neighbour").where("c = d").agg(F.sum("w")).first()[0] or 0.0
    inner += 2 * (loops.agg(F.sum("w")).first()[0] or 0.0)
    strength = arcs.select("node", "w").union(loops.select("node", 2 * F.col("w"))).groupBy("node").agg(F.sum("w").alias("k"))
    squares = labels.join(strength, "node").groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inner / (2 * m) - squares / (4 * m * m)


def _sweep(arcs: DataFrame, strength: DataFrame, labels: DataFrame, m: float, turn: int) -> DataFrame:
    """Move every node of this turn's half to the neighbouring community of greatest gain, if it is positive."""
    totals = labels.join(strength, "node").groupBy("c").agg(F.sum("k").alias("tot"))
    there = labels.select(F.col("node").alias("neighbour"), F.col("c"))
    links = arcs.join(there, "neighbour").groupBy("node", "c").agg(F.sum("w").alias("w"))
    own = labels.join(strength, "node").select("node", F.col("c").alias("own"), "k")
    options = own.select("node", F.col("own").alias("c")).union(links.select("node", "c")).distinct()
    options = options.join(links, ["node", "c"], "left").join(own, "node").join(totals, "c")
    rest = F.when(F.col("c") == F.col("own"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
    gain = F.coalesce("w", F.lit(0.0)) - F.col("k") * rest / (2 * m)
    best = options.withColumn("gain", gain).groupBy("node").agg(F.max_by("c", F.struct("gain", F.col("c") == F.col("own"), "c")).alias("best"), F.max("gain").alias("top"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
    mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
    moved = labels.join(best, "node", "left")
    goes = F.coalesce(mine & (F.col("top") > F.col("stay") + 1e-12), F.lit(False))
    return moved.select("node", F.when(goes, F.col("best")).otherwise(F.col("c")).alias("c"), goes.alias("moved"))


def louvain(g: Graph, weight: str = "weight", seed: int = 42) -> DataFrame:
    """N20. (node, community): local moves until no node moves or SWEEPS more sweeps gain less than LEAST_GAIN, then communities become nodes, until modularity gains less than LEAST_GAIN.

    Moves are synchronous; only half of the nodes, by a hash that changes every other sweep, may move at a time, so neighbours don't
    swap places for ever. A level that doesn't raise modularity is not kept. Communities are numbered from 0 by size, then least node.
    The arcs stay in blocks with the executors; labels and strengths of the nodes, a number each, go to and from the driver. Graphs too large for that go by joins,
    whose halves are dealt by another hash.
    """
    g = g.materialized()
    return _louvain_in_blocks(g, weight, seed) if fits(g) else louvain_by_joins(g, weight, seed)


def _mine(nodes: np.ndarray, turn: int) -> np.ndarray:
    """Which nodes may move: half of them by a hash, the other half in the next turn."""
    x = (nodes.astype(np.uint64) + np.uint64(1 + turn // 2)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(turn // 2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)) % np.uint64(2) == turn % 2


def _best(nodes: np.ndarray, own: np.ndarray, to: np.ndarray, w: np.ndarray, labels: np.ndarray, totals: np.ndarray, k: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that gain by moving, where to): the neighbouring community of greatest gain, the greatest number on ties. own: position in nodes of each arc."""
    here = labels[nodes]
    at = np.concatenate([own, np.arange(len(nodes))])
    c = np.concatenate([labels[to], here])
    order = np.lexsort((c, at))
    at, c, w = at[order], c[order], np.append(w, np.zeros(len(nodes)))[order]
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (c[1:] != c[:-1])))
    at, c, w = at[head], c[head], np.add.reduceat(w, head)
    mine = k[nodes][at]
    stays = c == here[at]
    gain = w - mine * (totals[c] - np.where(stays, mine, 0.0)) / (2 * m)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    top = np.maximum.reduceat(gain, first)
    stay = gain[stays]  # one a node, in their order
    choice = np.maximum.reduceat(np.where(gain == top[at], c, -1), first)
    goes = (top > stay + 1e-12) & (choice != here)
    return nodes[goes], choice[goes]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, position in nodes of each arc, neighbours, weights) of every block."""
    for batch in batches:
        for nodes, counts, to, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            nodes = np.frombuffer(nodes, np.int32)
            yield nodes, np.repeat(np.arange(len(nodes)), np.frombuffer(counts, np.int32)), np.frombuffer(to, np.int32), np.frombuffer(w, np.float64)


def _swept(blocks: DataFrame, labels: np.ndarray, totals: np.ndarray, k: object, m: float, turn: int | None) -> tuple[float, np.ndarray, np.ndarray]:
    """(weight of arcs inside communities of labels, nodes that move in this turn, where to)."""
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast(pickle.dumps((labels, totals)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, totals = pickle.loads(sent.value)
        for nodes, own, to, w in _unpack(batches):
            inner = float(w[labels[nodes][own] == labels[to]].sum())
            moved = where = np.empty(0, np.int32)
            if turn is not None:
                mine = _mine(nodes, turn)
                mapped = np.cumsum(mine) - 1
                arcs = mine[own]
                if mine.any():
                    moved, where = _best(nodes[mine], mapped[own[arcs]], to[arcs], w[arcs], labels, totals, k.value, m)
            yield pa.RecordBatch.from_arrays([pa.array([inner]), *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (moved, where)]], names=["inner", "moved", "target"])

    got = blocks.mapInArrow(run, "inner double, moved binary, target binary").toArrow().to_pylist()
    sent.destroy()
    got.sort(key=lambda r: (r["moved"], r["inner"]))  # one order of the sum on every run
    join = lambda c: np.frombuffer(b"".join(r[c] for r in got), np.int32)
    return sum(r["inner"] for r in got), join("moved"), join("target")


def _strengths(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, weights of their arcs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, own, _, w in _unpack(batches):
            yield pa.RecordBatch.from_arrays([pa.array([nodes.tobytes()], pa.binary()), pa.array([np.bincount(own, w, minlength=len(nodes)).tobytes()], pa.binary())], names=["nodes", "sums"])

    got = blocks.mapInArrow(run, "nodes binary, sums binary").toArrow().to_pylist()
    return np.frombuffer(b"".join(r["nodes"] for r in got), np.int32), np.frombuffer(b"".join(r["sums"] for r in got))


def _contracted(blocks: DataFrame, labels: np.ndarray) -> DataFrame:
    """(a, b, w): arcs between communities; those inside give a = b."""
    sent = blocks.sparkSession.sparkContext.broadcast(pickle.dumps(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pickle.loads(sent.value)
        for nodes, own, to, w in _unpack(batches):
            key = labels[nodes][own].astype(np.int64) << 32 | labels[to]
            pairs, place = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(np.bincount(place, w, minlength=len(pairs)))], names=["a", "b", "w"])

    return materialize(blocks.mapInArrow(run, "a int, b int, w double").groupBy("a", "b").agg(F.sum("w").alias("w")), "contracted")


def _louvain_in_blocks(g: Graph, weight: str, seed: int) -> DataFrame:
    p = packed(g, weight)
    blocks, n = p.blocks, p.n
    looped = g.edges.where("source = target").select(F.col("source").alias("node"), F.col(weight).cast("double").alias("w"))
    looped = looped.join(p.numbers, "node").groupBy("i").agg(F.sum("w").alias("w")).toArrow()
    loops = np.zeros(n)
    loops[looped["i"].to_numpy()] = looped["w"].to_numpy()
    m = g.edges.agg(F.sum(weight)).first()[0] or 0.0
    member = np.arange(n, dtype=np.int32)
    best_overall = None
    for _ in range(MAX_LEVELS if m > 0 else 0):
        k = 2 * loops
        nodes, sums = _strengths(blocks)
        k[nodes] += sums
        sent_k = blocks.sparkSession.sparkContext.broadcast(k)
        labels = np.arange(len(k), dtype=np.int32)
        looped_weight = 2 * float(loops.sum())
        quiet = turn = 0
        start = last = None
        while True:
            totals = np.bincount(labels, k, minlength=len(k))
            inner, moved, where = _swept(blocks, labels, totals, sent_k, m, None if quiet == 2 else turn + seed % 2)
            score = (inner + looped_weight) / (2 * m) - float((totals * totals).sum()) / (4 * m * m)
            if start is None:
                start = last = score
            elif turn % SWEEPS == 0 and quiet < 2:
                if score - last < LEAST_GAIN:
                    break
                last = score
            if quiet == 2:  # neither half moved
                break
            quiet = 0 if len(moved) else quiet + 1
            labels = labels.copy()
            labels[moved] = where
            turn += 1
        sent_k.destroy()
        if score - start < LEAST_GAIN or best_overall is not None and score - best_overall < LEAST_GAIN:
            break
        best_overall = score
        kept, up = np.unique(labels, return_inverse=True)
        up = up.astype(np.int32)
        member = up[member]
        arcs = _contracted(blocks, up)
        loops = np.bincount(up, loops, minlength=len(kept))
        inside = arcs.where("a = b").select("a", "w").toArrow()
        loops[inside["a"].to_numpy()] += inside["w"].to_numpy() / 2
        discard(blocks)
        blocks = blocks_of(arcs.where("a <> b"))
    table = pa.table({"i": np.arange(n, dtype=np.int32), "c": member})
    spark = g.vertices.sparkSession
    return _numbered(materialize(p.numbers.join(spark.createDataFrame(table), "i").select("node", "c"), "membership"))


def louvain_by_joins(g: Graph, weight: str = "weight", seed: int = 42) -> DataFrame:
    """The same for graphs of any size."""
    labels_of_nodes = g.vertices.select("node", F.col("node").alias("c"))
    arcs = materialize(g.without_loops().ends().select("node", "neighbour", F.col(weight).alias("w")), "arcs")
    loops = materialize(g.edges.where("source = target").select(F.col("source").alias("node"), F.col(weight).alias("w")), "loops")
    m = g.edges.agg(F.sum(weight)).first()[0] or 0.0
    if m <= 0:
        return _numbered(labels_of_nodes)
    best_overall = None
    for _ in range(MAX_LEVELS):
        strength = materialize(arcs.groupBy("node").agg(F.sum("w").alias("k")).union(loops.select("node", 2 * F.col("w"))).groupBy("node").agg(F.sum("k").alias("k")), "strength")
        nodes = labels_of_nodes.select(F.col("c").alias("node")).distinct()
        strength = nodes.join(strength, "node", "left").na.fill(0.0, ["k"])
        labels = materialize(nodes.select("node", F.col("node").alias("c")), "labels")
        start = _score(arcs, labels, loops, m)
        quiet = turn = 0
        last = start
        while True:
            swept = materialize(_sweep(arcs, strength, labels, m, turn + seed % 2), "labels")
            labels = swept.select("node", "c")
            quiet = 0 if swept.where("moved").limit(1).count() else quiet + 1
            if quiet == 2:  # neither half moves
                break
            turn += 1
            if turn % SWEEPS == 0:
                reached = _score(arcs, labels, loops, m)
                if reached - last < LEAST_GAIN:
                    break
                last = reached
        now = _score(arcs, labels, loops, m)
        if now - start < LEAST_GAIN or best_overall is not None and now - best_overall < LEAST_GAIN:
            break
        best_overall = now
        labels_of_nodes = materialize(labels_of_nodes.join(labels.select(F.col("node").alias("c"), F.col("c").alias("up")), "c").select("node", F.col("up").alias("c")), "membership")
        one = labels.select("node", F.col("c").alias("a"))
        two = labels.select(F.col("node").alias("neighbour"), F.col("c").alias("b"))
        joined = arcs.join(one, "node").join(two, "neighbour").groupBy("a", "b").agg(F.sum("w").alias("w"))
        joined = materialize(joined, "contracted")
        inner = joined.where("a = b").select(F.col("a").alias("node"), (F.col("w") / 2).alias("w")).union(loops.join(one, "node").select(F.col("a").alias("node"), "w"))
        loops = materialize(inner.groupBy("node").agg(F.sum("w").alias("w")), "loops")
        arcs = joined.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "w")
    return _numbered(labels_of_nodes)


def _numbered(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    numbers = ranked(sizes, [F.desc("size"), F.col("least")], rank="number").select("c", (F.col("number") - 1).alias("community"))
    return labels.join(numbers, "c").select("node", "community")


def community_sizes(partition: DataFrame) -> DataFrame:
    """G13, T8, N26."""
    return partition.groupBy("community").agg(F.count(F.lit(1)).alias("community_size"))


def community_table(partition: DataFrame) -> DataFrame:
    """N22, A7, W6, J8. (node, community, community_size, community_rank): rank by size, ties by community."""
    sizes = ranked(community_sizes(partition), [F.desc("community_size"), F.col("community")], rank="community_rank")
    return partition.join(sizes, "community").select("node", "community", "community_size", "community_rank")


def fixed_partition(g: Graph, block: int) -> DataFrame:
    """Communities by node number div `block`: a partition that SQL can give, for checks."""
    return g.vertices.select("node", F.expr(f"CAST(node AS BIGINT) div {int(block)}").alias("community"))


def top_sizes(partition: DataFrame, n: int = 20) -> DataFrame:
    """N26, T8."""
    return community_sizes(partition).orderBy(F.desc("community_size"), "community").limit(n)
