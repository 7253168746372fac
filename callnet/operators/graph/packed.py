"""A graph as adjacency lists of numbers, in blocks that a task can hold as numpy arrays."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callnet.functions.ordering import ranked
from callnet.operators.graph.core import Graph
from callnet.storage import materialize

#: A graph up to this size is held whole by a task (some 140 MB of arcs, 60 bytes of state per node); larger ones are searched by joins.
MAX_NODES, MAX_ARCS = 1 << 22, 1 << 25
#: Arcs that are looked at together.
STRETCH = 1 << 19
_BLOCK = "nodes binary, counts binary, neighbours binary, weights binary"


@dataclass(frozen=True)
class Packed:
    """numbers: (node, i), i from 0 in the order of the nodes. blocks: nodes, their numbers of arcs, and the arcs of all in a row; weights are those of a column or 1; blocks of `packed_giant` have none."""

    numbers: DataFrame
    blocks: DataFrame
    n: int
    weight: str | None = None


def fits(g: Graph) -> bool:
    return g.inside is not None or g.vertices.count() <= MAX_NODES and 2 * g.edges.count() <= MAX_ARCS


def numbered(g: Graph) -> DataFrame:
    return materialize(ranked(g.vertices.select("node"), [F.col("node")], rank="i").select("node", (F.col("i") - 1).cast("int").alias("i")), "numbers")


def _blocks(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of _BLOCK from arcs in the order of a; without weights, its first three columns."""
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
    ends = np.append(head[1:], len(a))
    at = 0
    while at < len(head):
        to = max(at + 1, int(np.searchsorted(ends, head[at] + STRETCH, "right")))
        own = slice(int(head[at]), int(ends[to - 1]))
        parts = [a[head[at:to]].astype(np.int32), (ends[at:to] - head[at:to]).astype(np.int32), b[own].astype(np.int32), *([] if w is None else [w[own].astype(np.float64)])]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["nodes", "counts", "neighbours", "weights"][: len(parts)])
        at = to


def blocks_of(arcs: DataFrame) -> DataFrame:
    """arcs: (a int, b int, w double), both directions. Rows with the arcs of some nodes each, by number; a node's arcs are in one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not got:
            return
        a, b, w = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        order = np.lexsort((w, b, a))
        a, b, w = a[order], b[order], w[order]
        yield from _blocks(a, b, w)

    return materialize(arcs.select("a", "b", "w").repartition("a").mapInArrow(pack, _BLOCK), "blocks")


def packed(g: Graph, weight: str | None = None) -> Packed:
    """The graph without loops; a null weight counts as 0."""
    numbers = numbered(g)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    ends = g.without_loops().edges.select("source", "target", w.alias("w"))
    ends = ends.join(numbers.select(F.col("node").alias("source"), F.col("i").alias("a")), "source").join(numbers.select(F.col("node").alias("target"), F.col("i").alias("b")), "target")
    both = ends.select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("arc")).select("arc.*")
    return Packed(numbers, blocks_of(both), numbers.count(), weight)


def places(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The position of each value in `among`, which is sorted and holds all of them."""
    if not len(among) or int(among[-1]) - int(among[0]) >= 8 * len(among):
        return np.searchsorted(among, values).astype(np.int32)
    table = np.zeros(int(among[-1]) - int(among[0]) + 1, np.int32)
    table[among - among[0]] = np.arange(len(among), dtype=np.int32)
    return table[values - among[0]]


def bundled(ties: DataFrame) -> DataFrame:
    """(source long, target long), written as rows (n, sources, targets) of some STRETCH pairs at most."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if n and (batch is None or n + batch.num_rows > STRETCH):
                yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*held, strict=True)]], names=["n", "sources", "targets"])
                held, n = [], 0
            if batch is not None and batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows

    return materialize(ties.select(*[F.col(c).cast("long") for c in ("source", "target")]).mapInArrow(gather, "n long, sources binary, targets binary"), "ties")


def unbundled(bundles: DataFrame) -> DataFrame:
    """(source, target) again."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], names=["source", "target"])

    return bundles.select("sources", "targets").mapInArrow(spread, "source long, target long")


def largest(label: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """A mask of the largest component; of those as large, that with the node whose text is least."""
    size = np.bincount(label, minlength=len(label))
    most = np.flatnonzero(size == size.max())
    if len(most) > 1:
        tied = np.flatnonzero(np.isin(label, most))
        most = label[tied[np.argmin(nodes[tied].astype(str))]]
    return label == most


def packed_giant(bundles: DataFrame) -> Packed | None:
    """The largest component of a graph of `bundled` pairs without loops, repeated ones once; one task numbers, sorts and searches. None for a graph too large for that."""
    if 2 * (bundles.agg(F.sum("n")).first()[0] or 0) > MAX_ARCS:
        return None
    parts = ["nodes", "counts", "neighbours"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.frombuffer(x, np.int64) for x in row] for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        if not got:
            return
        nodes = np.concatenate([x for row in got for x in row])
        nodes.sort()
        nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])]
        if len(nodes) > MAX_NODES:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in (pa.int64(), pa.int32(), *[pa.binary()] * 3)], names=["node", "i", *parts])
            return
        got = [[places(x, nodes) for x in row] for row in got]
        # sorted as a whole: 32 bits of the node, 32 of the neighbour
        arcs = np.concatenate([x.astype(np.int64) << 32 | y for s, t in got for x, y in ((s, t), (t, s))])
        del got
        arcs.sort()
        arcs = arcs[np.append(True, arcs[1:] != arcs[:-1]) & (arcs >> 32 != arcs & 0xFFFFFFFF)]
        a, b = (arcs >> 32).astype(np.int32), arcs.astype(np.int32)
        del arcs
        blocks = list(_blocks(a, b))
        keep = largest(components(Lists(len(nodes), [[x.as_py() for (x,) in block.columns] for block in blocks])), nodes)
        if not keep.all():
            new, inside = np.cumsum(keep, dtype=np.int32) - 1, keep[a]
            blocks, nodes = _blocks(new[a[inside]], new[b[inside]]), nodes[keep]
        for block in blocks:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), *block.columns], names=["node", "i", *parts])
        for first in range(0, len(nodes), STRETCH):
            own = nodes[first : first + STRETCH]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(first, first + len(own), dtype=np.int32)), *[pa.nulls(len(own), pa.binary()) for _ in parts]], names=["node", "i", *parts])

    whole = materialize(bundles.select("sources", "targets").repartition(1).mapInArrow(pack, "node long, i int, nodes binary, counts binary, neighbours binary"), "whole")
    n, refused = whole.agg(F.count("node"), F.count(F.lit(1)) - F.count("node") - F.count("nodes")).first()
    return None if refused else Packed(whole.where("node IS NOT NULL").select("node", "i"), whole.where("nodes IS NOT NULL").select(*parts), n)


def surrounding(g: Graph, weight: str | None = None) -> Packed:
    """The graph, or a packed one of which it is whole components: what goes along arcs from its nodes doesn't leave them."""
    return g.inside if g.inside is not None and weight in (None, g.inside.weight) else packed(g, weight)


class Lists:
    """The whole graph in a task: the arcs of node v are neighbours[start[v] : start[v] + count[v]]; their weights alike, where blocks have them."""

    def __init__(self, n: int, blocks: list[list[bytes]]):
        self.n, self.start, self.count = n, np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.neighbours = np.empty(sum(len(b[2]) for b in blocks) // 4, np.int32)
        self.weights = np.empty(len(self.neighbours) if blocks and len(blocks[0]) > 3 else 0)
        at, order = 0, []
        while blocks:
            own = blocks.pop()
            nodes, counts, neighbours = (np.frombuffer(x, np.int32) for x in own[:3])
            if len(own) > 3:
                self.weights[at : at + len(neighbours)] = np.frombuffer(own[3])
            self.count[nodes] = counts
            self.start[nodes] = at + np.cumsum(counts, dtype=np.int64) - counts
            self.neighbours[at : at + len(neighbours)] = neighbours
            at += len(neighbours)
            order.append(nodes)
        #: nodes with arcs, in the order of their arcs
        self.order = np.concatenate(order) if order else np.empty(0, np.int32)

    def runs(self) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """(nodes, their arcs, where in these each node's begin) over all nodes with arcs, some STRETCH arcs at a time."""
        ends = np.cumsum(self.count[self.order])
        at = 0
        while at < len(self.order):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + STRETCH, "right")))
            yield self.order[at:to], slice(base, int(ends[to - 1])), np.append(base, ends[at : to - 1]) - base
            at = to

    def stretches(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of nodes with some STRETCH arcs in all."""
        ends = np.cumsum(self.count[nodes])
        at = 0
        while at < len(nodes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
            yield nodes[at:to]
            at = to

    def arcs(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in nodes, neighbour) of all arcs of the nodes."""
        count = self.count[nodes]
        own = np.repeat(np.arange(len(nodes)), count)
        shift = self.start[nodes] - (np.cumsum(count) - count)
        return own, self.neighbours[np.arange(len(own)) + shift[own]]


def distances(g: Lists, roots: np.ndarray) -> tuple[int, int]:
    """(sum of distances, pairs) over the nodes reached from the roots, breadth first from 64 of them at a time, a bit each.

    A level looks at the neighbours of the last one while these are few, then at all nodes, then at those that not all roots have reached.
    """
    total = pairs = 0
    n_arcs = len(g.neighbours)
    for first in range(0, len(roots), 64):
        own = roots[first : first + 64]
        seen = np.zeros(g.n, np.uint64)
        np.bitwise_or.at(seen, own, np.uint64(1) << np.arange(len(own), dtype=np.uint64))
        every = np.bitwise_or.reduce(seen)
        last, depth, reached = seen.copy(), 0, own
        while True:
            depth += 1
            now = np.zeros(g.n, np.uint64)
            few = None
            if int(g.count[reached].sum()) * 32 < n_arcs:
                few = np.zeros(g.n, bool)
                few[g.arcs(reached)[1]] = True
                few = np.flatnonzero(few)
            elif depth > 2:
                few = np.flatnonzero((seen != every) & (g.count > 0))
            if few is None or int(g.count[few].sum()) * 2 > n_arcs:
                for nodes, arcs, heads in g.runs():
                    now[nodes] = np.bitwise_or.reduceat(last[g.neighbours[arcs]], heads)
            else:
                for nodes in g.stretches(few):
                    own_arcs = g.arcs(nodes)[1]
                    now[nodes] = np.bitwise_or.reduceat(last[own_arcs], np.cumsum(g.count[nodes]) - g.count[nodes])
            now &= ~seen
            found = int(np.bitwise_count(now).sum())
            if not found:
                break
            total, pairs = total + depth * found, pairs + found
            seen |= now
            last, reached = now, np.flatnonzero(now)
    return total, pairs


def dependencies(g: Lists, roots: np.ndarray) -> np.ndarray:
    """Brandes' sums of the dependencies of the roots on each node other than the root."""
    out = np.zeros(g.n)
    for root in roots:
        depth = np.full(g.n, -1, np.int32)
        sigma = np.zeros(g.n)
        depth[root], sigma[root] = 0, 1.0
        levels = [np.array([root])]
        while len(levels[-1]):
            got = np.zeros(g.n)
            for part in g.stretches(levels[-1]):
                own, to = g.arcs(part)
                new = depth[to] < 0
                got += np.bincount(to[new], sigma[part][own[new]], minlength=g.n)
            nxt = np.flatnonzero(got)
            depth[nxt], sigma[nxt] = len(levels), got[nxt]
            levels.append(nxt)
        delta = np.zeros(g.n)
        for level in range(len(levels) - 2, 0, -1):
            got = np.zeros(g.n)
            for part in g.stretches(levels[level]):
                own, to = g.arcs(part)
                back = depth[to] == level - 1
                got += np.bincount(to[back], ((1 + delta[part]) / sigma[part])[own[back]], minlength=g.n)
            delta += sigma * got
        delta[root] = 0.0
        out += delta
    return out


def components(g: Lists) -> np.ndarray:
    """The least node of each node's component: labels go along arcs, from label to label, and to what a label stood for."""
    label = np.arange(g.n, dtype=np.int32)
    while True:
        far = label[label]
        least = far.copy()
        for nodes, arcs, heads in g.runs():
            least[nodes] = np.minimum(least[nodes], np.minimum.reduceat(far[g.neighbours[arcs]], heads))
        now = least.copy()
        np.minimum.at(now, label, least)
        now = np.minimum(now, now[now])
        if np.array_equal(now, label):
            return label
        label = now


def power_iteration(g: Lists, loops: np.ndarray, inside: np.ndarray, max_steps: int, tolerance: float) -> np.ndarray | None:
    """The vector of `centrality.eigenvector` over the nodes of `inside` (a mask of whole components); None without convergence. loops: their weights by node."""
    n = int(inside.sum())
    x = np.where(inside, 1.0 / n**0.5 if n else 0.0, 0.0)
    for _ in range(max_steps):
        y = x + loops * x
        for nodes, arcs, heads in g.runs():
            y[nodes] += np.add.reduceat(x[g.neighbours[arcs]] * g.weights[arcs], heads)
        y /= float(np.sqrt((y * y).sum())) or 1.0
        change, x = float(np.abs(y - x).sum()), y
        if change < n * tolerance:
            return x
    return None


def _by_roots(p: Packed, roots: DataFrame, k: int | None, work, columns: list[str], schema: str, least: int = 1) -> DataFrame:
    """`work` over the whole graph and a share of the roots in every task, some `least` or more."""
    tasks = max(1, min(p.numbers.sparkSession.sparkContext.defaultParallelism, -(-(k or p.n) // least)))
    chosen = roots.select(F.col("root").alias("node")).join(p.numbers, "node")
    place = F.row_number().over(Window.orderBy("i")) if k else F.col("i")  # a sample is small
    rows = chosen.select((place % tasks).cast("int").alias("task"), F.col("i").alias("root"), *[F.lit(None).cast("binary").alias(c) for c in ("nodes", "counts", "neighbours")])
    graph = p.blocks.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(None).cast("int").alias("root"), "nodes", "counts", "neighbours")
    n = p.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks = [], []
        for batch in batches:
            for root, *block in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True):
                if root is None:
                    blocks.append(block)
                else:
                    own.append(root)
        if own:
            # sorted, so that sums don't depend on the order in which rows arrive
            blocks.sort(key=lambda b: b[0][:4], reverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(Lists(n, blocks), np.array(sorted(own)))], names=columns)

    return materialize(rows.union(graph).repartitionById(tasks, "task").mapInArrow(run, schema), "searched")


def path_sums(p: Packed, roots: DataFrame, k: int | None) -> DataFrame:
    """(distance, pairs), one row per task."""
    return _by_roots(p, roots, k, lambda g, own: [[x] for x in distances(g, own)], ["distance", "pairs"], "distance long, pairs long", 64)


def dependency_sums(p: Packed, roots: DataFrame, k: int | None) -> DataFrame:
    """(node, delta) with delta > 0."""

    def work(g: Lists, own: np.ndarray) -> list[np.ndarray]:
        found = dependencies(g, own)
        hit = np.flatnonzero(found)
        return [hit.astype(np.int32), found[hit]]

    part = _by_roots(p, roots, k, work, ["i", "delta"], "i int, delta double")
    return part.groupBy("i").agg(F.sum("delta").alias("delta")).join(p.numbers, "i").select("node", "delta")


def _in_one_task(p: Packed, rows: DataFrame | None, work, columns: list[str], schema: str, weights: bool = False) -> DataFrame:
    """`work` over the whole graph and the rows (i, value double) in one task."""
    parts = ["nodes", "counts", "neighbours", *["weights"] * weights]
    graph = p.blocks.select(F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("value"), *parts)
    if rows is not None:
        graph = graph.union(rows.select("i", "value", *[F.lit(None).cast("binary") for _ in parts]))
    n = p.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, values, blocks = [], [], []
        for batch in batches:
            is_row = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            own.append(batch.column(0).filter(pa.array(is_row)).to_numpy())
            values.append(batch.column(1).filter(pa.array(is_row)).to_numpy())
            blocks += [list(b) for b in zip(*[c.filter(pa.array(~is_row)).to_pylist() for c in batch.columns[2:]], strict=True)]
        blocks.sort(key=lambda b: b[0][:4], reverse=True)
        at, value = (np.concatenate(c) if c else np.empty(0, kind) for c, kind in ((own, np.int32), (values, np.float64)))
        made = work(Lists(n, blocks), at, value)
        for first in range(0, len(made[0]), STRETCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[first : first + STRETCH]) for c in made], names=columns)

    return materialize(graph.repartition(1).mapInArrow(run, schema), "whole")


def component_numbers(p: Packed) -> DataFrame:
    """(i, component): the least number of each node's component."""

    def work(g: Lists, _: np.ndarray, __: np.ndarray) -> list[np.ndarray]:
        return [np.arange(g.n, dtype=np.int32), components(g)]

    return _in_one_task(p, None, work, ["i", "component"], "i int, component int")


def principal_vector(p: Packed, inside: DataFrame, loops: DataFrame, max_steps: int, tolerance: float) -> DataFrame:
    """(node, eigenvector) of the nodes in `inside`, whole components of the graph; loops: (node, w). No row for them without convergence."""
    weights = loops.groupBy("node").agg(F.sum(F.col("w").cast("double")).alias("value"))
    rows = inside.select("node").join(p.numbers, "node").join(weights, "node", "left").select("i", F.coalesce("value", F.lit(0.0)).alias("value"))

    def work(g: Lists, own: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        weight, mask = np.zeros(g.n), np.zeros(g.n, bool)
        weight[own], mask[own] = value, True
        found = power_iteration(g, weight, mask, max_steps, tolerance)
        own = np.sort(own) if found is not None else own[:0]
        return [own.astype(np.int32), found[own] if found is not None else np.empty(0)]

    return _in_one_task(p, rows, work, ["i", "eigenvector"], "i int, eigenvector double", weights=True).join(p.numbers, "i").select("node", "eigenvector")
