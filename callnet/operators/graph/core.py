"""The graph itself and what one or two aggregates tell of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callnet.functions.scalars import safe_ratio
from callnet.operators.graph.components import component_labels
from callnet.storage import materialize


@dataclass(frozen=True)
class Graph:
    """Undirected: vertices(node), edges(source, target, attributes), one row per unordered pair; loops are allowed.

    inside: the `Packed` form of a graph that has these nodes and edges as whole components, if there is one.
    """

    vertices: DataFrame
    edges: DataFrame
    inside: object | None = None

    @staticmethod
    def from_edges(edges: DataFrame, self_loops: str = "keep") -> Graph:
        """S11, N25. Vertices are all ends; dropping loops keeps their nodes."""
        if self_loops not in ("keep", "drop"):
            raise ValueError(f"self_loops is 'keep' or 'drop', not {self_loops!r}")
        vertices = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
        return Graph(vertices, edges if self_loops == "keep" else edges.where("source <> target"))

    def materialized(self) -> Graph:
        """Both tables written, those that are already stay as they are."""
        kept = lambda t, name: t if hasattr(t, "written_to") else materialize(t, name)
        return Graph(kept(self.vertices, "vertices"), kept(self.edges, "edges"), self.inside)

    def without_loops(self) -> Graph:
        """N25."""
        return Graph(self.vertices, self.edges.where("source <> target"), self.inside)

    def ends(self) -> DataFrame:
        """Both directions of every edge; a loop gives two rows."""
        rest = [c for c in self.edges.columns if c not in ("source", "target")]
        return self.edges.select("source", "target", *rest).union(self.edges.select("target", "source", *rest)).withColumnsRenamed({"source": "node", "target": "neighbour"})

    def induced(self, nodes: DataFrame) -> Graph:
        """J9. The subgraph of the given nodes (a column `node`)."""
        keep = nodes.select("node").distinct()
        edges = self.edges.join(keep, self.edges["source"] == keep["node"], "left_semi")
        edges = edges.join(keep, edges["target"] == keep["node"], "left_semi")
        return Graph(self.vertices.join(keep, "node", "left_semi"), edges)


def counts(g: Graph) -> DataFrame:
    """N1, N2. Nodes, edges, density 2m / (n (n - 1)); loops count as edges; 0 for a single node."""
    n = g.vertices.agg(F.count(F.lit(1)).alias("n_nodes"))
    m = g.edges.agg(F.count(F.lit(1))).scalar()
    out = n.withColumn("n_edges", m)
    return out.withColumn("density", F.coalesce(safe_ratio(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)))


def degrees(g: Graph) -> DataFrame:
    """N3, N4. Degree and strength (sum of q_calls, where edges have it); a loop counts twice, an isolated node 0."""
    aggregates = [F.count(F.lit(1)).alias("degree")]
    if "q_calls" in g.edges.columns:
        aggregates.append(F.sum("q_calls").alias("strength"))
    got = g.ends().groupBy("node").agg(*aggregates)
    return g.vertices.join(got, "node", "left").na.fill(0, [c for c in got.columns if c != "node"])


def components(g: Graph) -> DataFrame:
    """N5. (node, component): the least node reachable."""
    labels = component_labels(g.edges.select("source", "target")).select(F.col("id").alias("node"), F.col("label").alias("component"))
    return g.vertices.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(found: DataFrame) -> DataFrame:
    """N5, G13, T8."""
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def giant(g: Graph, found: DataFrame | None = None) -> Graph:
    """G18, J9. The largest component (the one with the least node on ties)."""
    from callnet.operators.graph import packed

    inside = None
    if found is None:
        g = g.materialized()
        if packed.fits(g):
            inside = packed.packed(g, "weight" if "weight" in g.edges.columns else None)
            found = packed.component_numbers(inside).join(inside.numbers, "i").select("node", "component")
    found = materialize(components(g) if found is None else found, "components")
    largest = component_sizes(found).orderBy(F.desc("size"), "component").limit(1).select("component")
    keep = found.join(F.broadcast(largest), "component", "left_semi").select("node")
    # an edge's ends are in one component
    return Graph(materialize(keep, "vertices"), g.edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").select(*g.edges.columns), inside)


def giant_of_ties(ties: DataFrame) -> Graph:
    """`giant` without loops and attributes, of the graph of (source long, target long), whose rows may repeat in both directions. Nodes are numbers where a task can hold the graph, else text."""
    from callnet.operators.graph import packed

    bundles = packed.bundled(ties.where("source IS NOT NULL AND target IS NOT NULL"))
    pairs = packed.unbundled(bundles).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    inside = packed.packed_giant(bundles)
    if inside is None:
        return giant(Graph.from_edges(pairs.select(*[F.col(c).cast("string").alias(c) for c in pairs.columns]))).without_loops()
    vertices = inside.numbers.select("node")
    return Graph(vertices, pairs.where("source <> target").join(vertices.withColumnRenamed("node", "source"), "source", "left_semi"), inside)


def giant_share(found: DataFrame) -> DataFrame:
    """N5. Number of components, size of the largest, its share of the nodes."""
    s = component_sizes(found).agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("giant_size"), F.sum("size").alias("n"))
    return s.select("n_components", "giant_size", F.round(safe_ratio(F.col("giant_size"), F.col("n")), 9).alias("giant_share"))


def degree_histogram(g: Graph) -> DataFrame:
    """One row per degree; lossless for every use of the degree sequence here."""
    return degrees(g).groupBy(F.col("degree").alias("k")).agg(F.count(F.lit(1)).alias("n_k"))


def _degree_pairs(g: Graph) -> DataFrame:
    """Degrees of both ends over both directions of each edge."""
    d = degrees(g).select("node", "degree")
    one = g.ends().select("node", "neighbour").join(d.withColumnRenamed("degree", "k"), "node")
    return one.join(d.select(F.col("node").alias("neighbour"), F.col("degree").alias("k_neighbour")), "neighbour").select("k", "k_neighbour")


def assortativity(g: Graph) -> DataFrame:
    """N11. Correlation of the degrees at both ends; null if all degrees are equal."""
    p = _degree_pairs(g)
    guard = F.when((F.min("k") < F.max("k")), F.lit(1))
    sums = p.agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("double").alias("s"), F.sum(F.col("k") * F.col("k")).cast("double").alias("ss"), F.sum(F.col("k") * F.col("k_neighbour")).cast("double").alias("sp"), guard.alias("varies"))
    # both ends have the same distribution, so one mean and one variance serve
    mean = safe_ratio(F.col("s"), F.col("n"))
    r = safe_ratio(safe_ratio(F.col("sp"), F.col("n")) - mean * mean, safe_ratio(F.col("ss"), F.col("n")) - mean * mean)
    return sums.select(F.when(F.col("varies").isNotNull(), F.round(r, 9)).alias("assortativity"))


def neighbour_degree(g: Graph) -> DataFrame:
    """N12. Mean degree of the neighbours of nodes of degree k."""
    return _degree_pairs(g).groupBy("k").agg(F.round(F.avg("k_neighbour"), 9).alias("mean_neighbour_degree"))
