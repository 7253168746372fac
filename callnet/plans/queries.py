"""Queries by name, over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callnet.functions.scalars import CALL_BANDS, DISTANCE_BANDS
from callnet.operators import bands, edges, profile, quality, rankings, residence, spatial
from callnet.operators.graph import centrality, clustering, community, core, kcore, paths, powerlaw, random_graph, robustness
from callnet.plans import sql as S
from callnet.sources import fixtures, tables
from callnet.storage import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *parts: str, select: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if select is not None:
            ORACLE_SQL[name] = S.with_(*parts, select=select)
        return f

    return register


_views: dict[tuple[object, ...], object] = {}


def once(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], object]) -> object:
    """A result that several queries need, built once per application and state of the input files (all parts of it are written tables)."""
    state = tuple(tables.stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem"))
    key = (spark.sparkContext.applicationId, sf_dir, state, name)
    if key not in _views:
        _views[key] = build()
    return _views[key]


def sparse_graph(spark: SparkSession, sf_dir: str) -> core.Graph:
    return once("sparse", spark, sf_dir, lambda: core.Graph.from_edges(materialize(edges.undirected_edges(fixtures.edges(spark, sf_dir, "sparse")), "undirected")).materialized())


def dense_graph(spark: SparkSession, sf_dir: str) -> core.Graph:
    return once("dense", spark, sf_dir, lambda: core.Graph.from_edges(materialize(edges.undirected_edges(fixtures.edges(spark, sf_dir, "dense")), "undirected")).materialized())


def sparse_giant(spark: SparkSession, sf_dir: str) -> core.Graph:
    """Without loops, as all structural metrics take it."""
    return once("sparse_giant", spark, sf_dir, lambda: core.giant(sparse_graph(spark, sf_dir)).without_loops().materialized())


def dense_component(spark: SparkSession, sf_dir: str) -> core.Graph:
    """Its edges are a plan over written tables."""
    return once("dense_component", spark, sf_dir, lambda: core.giant(dense_graph(spark, sf_dir)))


def dense_giant(spark: SparkSession, sf_dir: str) -> core.Graph:
    return once("dense_giant", spark, sf_dir, lambda: dense_component(spark, sf_dir).materialized())


def dense_ties(spark: SparkSession, sf_dir: str) -> core.Graph:
    """The nodes and pairs of `dense_component`, derived without sums and weights."""
    return once("dense_ties", spark, sf_dir, lambda: core.giant_of_ties(fixtures.ties(spark, sf_dir)))


def dense_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("cores", spark, sf_dir, lambda: materialize(kcore.core_numbers(dense_giant(spark, sf_dir)), "cores"))


def dense_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("communities", spark, sf_dir, lambda: materialize(community.louvain(dense_giant(spark, sf_dir)), "communities"))


def antenna_edges(spark: SparkSession, sf_dir: str, kind: str = "calls") -> DataFrame:
    return residence.edges_with_antennas(fixtures.edges(spark, sf_dir, kind), residence.normal_residences(fixtures.residences(spark, sf_dir)))


# -- scans and profiles ------------------------------------------------------------------------------------------------

_PROFILE = [("id_emisor", "string"), ("total_calls_make", "bigint"), ("unique_receivers", "bigint"), ("IDs_receivers_corr", "array<string>"), ("q_calls_corr", "array<bigint>"), ("residence_distance_km_corr", "array<double>"), ("calls_duration_total_corr", "array<double>")]


@query(
    "column_profile", S.EDGES, S.EMITTERS,
    select=" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS data_type, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null, round(count_if({c} IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_fraction, count(DISTINCT {c}) + CAST(count_if({c} IS NULL) > 0 AS BIGINT) AS n_distinct FROM emitters" for c, t in _PROFILE),
)
def column_profile(spark, sf_dir):
    return quality.column_profile(fixtures.emitters(spark, sf_dir))


@query("table_info", S.EDGES, select=" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS n_present FROM edges" for c, t in [("id_emisor", "string"), ("id_receiver", "string"), ("q_calls", "bigint"), ("residence_distance_km", "double"), ("calls_duration_total", "double"), ("avg_duration_per_call", "double")]))
def table_info(spark, sf_dir):
    return tables.table_info(fixtures.edges(spark, sf_dir))


@query("table_shape", S.RESIDENCES, select="SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM residences")
def table_shape(spark, sf_dir):
    return tables.table_shape(fixtures.residences(spark, sf_dir))


@query("edge_preview", S.EDGES, select="SELECT id_emisor, id_receiver, q_calls, residence_distance_km FROM edges ORDER BY id_emisor, id_receiver LIMIT 5")
def edge_preview(spark, sf_dir):
    return tables.preview(fixtures.edges(spark, sf_dir), ["id_emisor", "id_receiver"], 5).select("id_emisor", "id_receiver", "q_calls", "residence_distance_km")


_LISTS = quality.LISTS
_LENGTHS = ", ".join(f"len({c}) AS len_{c}" for c in _LISTS)
_SAME = " AND ".join(f"len({_LISTS[0]}) = len({c})" for c in _LISTS[1:])


@query(
    "table_checks", S.EDGES, S.EMITTERS, S.DIRTY,
    select=f"""SELECT count(*) AS n_rows, count(DISTINCT id_emisor) AS n_ids, count(id_emisor) - count(DISTINCT id_emisor) AS n_duplicate_ids,
    bool_and(unique_receivers = len(IDs_receivers_corr)) AS receivers_agree, bool_and({_SAME}) AS lengths_agree,
    bool_and(total_calls_make = coalesce(list_sum(q_calls_corr), 0)) AS totals_agree FROM dirty""",
)
def table_checks(spark, sf_dir):
    return quality.table_checks(fixtures.emitters(spark, sf_dir, dirty=True))


@query(
    "inconsistencies", S.EDGES, S.EMITTERS, S.DIRTY,
    select=f"""SELECT id_emisor, total_calls_make, CAST(coalesce(list_sum(q_calls_corr), 0) AS BIGINT) AS sum_q_calls, unique_receivers, {_LENGTHS} FROM dirty
    WHERE unique_receivers <> len(IDs_receivers_corr) OR NOT ({_SAME}) OR total_calls_make <> coalesce(list_sum(q_calls_corr), 0)""",
)
def inconsistencies(spark, sf_dir):
    return quality.inconsistencies(fixtures.emitters(spark, sf_dir, dirty=True))


@query(
    "global_summary", S.EDGES, S.EMITTERS,
    select="""SELECT count(DISTINCT id_emisor) AS n_emitters, CAST(sum(total_calls_make) AS BIGINT) AS total_calls, CAST(sum(unique_receivers) AS BIGINT) AS total_receivers,
    round(avg(total_calls_make), 6) AS mean_calls, median(total_calls_make) AS median_calls,
    round(avg(total_calls_make / CAST(nullif(unique_receivers, 0) AS DOUBLE)), 6) AS mean_calls_per_receiver,
    round(median(total_calls_make / CAST(nullif(unique_receivers, 0) AS DOUBLE)), 6) AS median_calls_per_receiver FROM emitters""",
)
def global_summary(spark, sf_dir):
    return profile.global_summary(fixtures.emitters(spark, sf_dir))


_RATED = ", rated AS (SELECT *, total_calls_make / CAST(nullif(unique_receivers, 0) AS DOUBLE) AS calls_per_receiver FROM emitters) "


@query("describe_emitters", S.EDGES, S.EMITTERS + _RATED, select=S.describe("rated", ["total_calls_make", "unique_receivers", "calls_per_receiver"], list(profile.EMITTER_PERCENTILES)))
def describe_emitters(spark, sf_dir):
    return profile.describe(profile.with_rates(fixtures.emitters(spark, sf_dir)), ["total_calls_make", "unique_receivers", "calls_per_receiver"], profile.EMITTER_PERCENTILES)


_EDGE_NUMBERS = ["q_calls", "calls_duration_total", "avg_duration_per_call", "residence_distance_km"]


@query("describe_edges", S.EDGES, select=S.describe("edges", _EDGE_NUMBERS, list(profile.EMITTER_PERCENTILES)))
def describe_edges(spark, sf_dir):
    return profile.describe(fixtures.edges(spark, sf_dir), _EDGE_NUMBERS, profile.EMITTER_PERCENTILES)


def _histograms() -> None:
    def add(name: str, source: Query, value: str, bins: int, parts: list[str], table: str, log: bool = False) -> None:
        def run(spark, sf_dir):
            c = F.col(value)
            return profile.histogram(source(spark, sf_dir), F.log1p(c) if log else c, bins)

        QUERIES[name] = run
        ORACLE_SQL[name] = S.with_(*parts, select="").rstrip() + S.histogram(table, f"ln(1 + {value})" if log else value, bins)

    emitters = lambda spark, sf_dir: profile.with_rates(fixtures.emitters(spark, sf_dir))
    e = [S.EDGES, S.EMITTERS + _RATED]
    add("histogram_calls", emitters, "total_calls_make", 60, e, "rated")
    add("histogram_calls_log", emitters, "total_calls_make", 60, e, "rated", log=True)
    add("histogram_receivers", emitters, "unique_receivers", 40, e, "rated")
    add("histogram_calls_per_receiver", emitters, "calls_per_receiver", 50, e, "rated")
    add("histogram_edge_calls", fixtures.edges, "q_calls", 60, [S.EDGES], "edges")
    add("histogram_edge_calls_log", fixtures.edges, "q_calls", 60, [S.EDGES], "edges", log=True)
    add("histogram_duration_log", fixtures.edges, "calls_duration_total", 70, [S.EDGES], "edges", log=True)
    add("histogram_mean_duration_log", fixtures.edges, "avg_duration_per_call", 70, [S.EDGES], "edges", log=True)
    add("histogram_distance", fixtures.edges, "residence_distance_km", 80, [S.EDGES], "edges")
    add("histogram_distance_log", fixtures.edges, "residence_distance_km", 80, [S.EDGES], "edges", log=True)
    top = ", conc AS (SELECT id_emisor, max(q_calls) / CAST(sum(q_calls) AS DOUBLE) AS top_share FROM edges GROUP BY id_emisor)"
    add("histogram_top_share", lambda spark, sf_dir: rankings.concentration(fixtures.edges(spark, sf_dir)), "top_share", 40, [S.EDGES + top.replace("max(q_calls) / CAST(sum(q_calls) AS DOUBLE)", "round(max(q_calls) / CAST(sum(q_calls) AS DOUBLE), 9)")], "conc")
    add("histogram_degree", lambda spark, sf_dir: core.degrees(sparse_graph(spark, sf_dir)), "degree", 50, [S.SPARSE, S.GRAPH], "degrees")
    add("histogram_centrality_degree", lambda spark, sf_dir: core.degrees(sparse_giant(spark, sf_dir)), "degree", 40, [S.SPARSE, S.GRAPH, S.COMPONENTS], "gdegrees")
    blocks = ", blocks AS (SELECT CAST(node AS BIGINT) // 30 AS community, count(*) AS community_size FROM nodes GROUP BY 1)"
    add("histogram_community_sizes", lambda spark, sf_dir: community.community_sizes(community.fixed_partition(sparse_graph(spark, sf_dir), 30)), "community_size", 30, [S.SPARSE, S.GRAPH + blocks], "blocks")


_histograms()


@query("scatter_calls_receivers", S.EDGES, S.EMITTERS, select="SELECT total_calls_make, unique_receivers FROM emitters WHERE total_calls_make IS NOT NULL AND unique_receivers IS NOT NULL")
def scatter_calls_receivers(spark, sf_dir):
    return profile.scatter(fixtures.emitters(spark, sf_dir), "total_calls_make", "unique_receivers")


# -- rankings ----------------------------------------------------------------------------------------------------------


@query("top_emitters", S.EDGES, S.EMITTERS, select="SELECT id_emisor, total_calls_make, unique_receivers FROM emitters ORDER BY total_calls_make DESC, id_emisor LIMIT 15")
def top_emitters(spark, sf_dir):
    return rankings.top(fixtures.emitters(spark, sf_dir).select("id_emisor", "total_calls_make", "unique_receivers"), ["total_calls_make"], ["id_emisor"])


@query(
    "pareto_curve", S.EDGES, S.EMITTERS,
    select="""SELECT id_emisor, total_calls_make, row_number() OVER w AS rank, round(row_number() OVER w / CAST(count(*) OVER () AS DOUBLE), 9) AS share_of_emitters,
    round(CAST(sum(total_calls_make) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(total_calls_make) OVER (), 9) AS share_of_calls
    FROM emitters WINDOW w AS (ORDER BY total_calls_make DESC, id_emisor)""",
)
def pareto_curve(spark, sf_dir):
    return rankings.pareto_curve(fixtures.emitters(spark, sf_dir))


@query(
    "pareto_cuts", S.EDGES, S.EMITTERS,
    select="""SELECT cut, n_top, round(CAST(sum(total_calls_make) AS DOUBLE) / any_value(total), 9) AS share_of_calls FROM
    (SELECT total_calls_make, row_number() OVER (ORDER BY total_calls_make DESC, id_emisor) AS rn, count(*) OVER () AS n, sum(total_calls_make) OVER () AS total FROM emitters),
    (SELECT CAST(unnest([0.01, 0.05, 0.1, 0.2]) AS DOUBLE) AS cut), LATERAL (SELECT greatest(1, CAST(ceil(cut * CAST(n AS DOUBLE)) AS BIGINT)) AS n_top)
    WHERE rn <= n_top GROUP BY cut, n_top""",
)
def pareto_cuts(spark, sf_dir):
    return rankings.pareto_cuts(fixtures.emitters(spark, sf_dir))


@query("top_edges", S.EDGES, select="SELECT id_emisor, id_receiver, q_calls FROM edges ORDER BY q_calls DESC, id_emisor, id_receiver LIMIT 15")
def top_edges(spark, sf_dir):
    return rankings.top(fixtures.edges(spark, sf_dir).select("id_emisor", "id_receiver", "q_calls"), ["q_calls"], ["id_emisor", "id_receiver"])


_CONCENTRATION = """SELECT id_emisor, CAST(sum(q_calls) AS BIGINT) AS calls, count(DISTINCT id_receiver) AS receivers, max(q_calls) AS top_calls,
    round(max(q_calls) / CAST(sum(q_calls) AS DOUBLE), 9) AS top_share, round(CAST(sum(q_calls) AS DOUBLE) / count(DISTINCT id_receiver), 9) AS calls_per_receiver FROM edges GROUP BY id_emisor"""


@query("concentration", S.EDGES, select=_CONCENTRATION)
def concentration(spark, sf_dir):
    return rankings.concentration(fixtures.edges(spark, sf_dir))


@query("top_concentration", S.EDGES, select=f"SELECT * FROM ({_CONCENTRATION}) ORDER BY top_share DESC, calls DESC, id_emisor LIMIT 15")
def top_concentration(spark, sf_dir):
    return rankings.top(rankings.concentration(fixtures.edges(spark, sf_dir)), ["top_share", "calls"], ["id_emisor"])


# -- edges and bands ---------------------------------------------------------------------------------------------------


@query(
    "edge_explode", S.EDGES, S.EMITTERS, S.DIRTY,
    select="""SELECT id_emisor, IDs_receivers_corr[i] AS id_receiver, q_calls_corr[i] AS q_calls, residence_distance_km_corr[i] AS residence_distance_km,
    calls_duration_total_corr[i] AS calls_duration_total, round(calls_duration_total_corr[i] / q_calls_corr[i], 8) AS avg_duration_per_call
    FROM (SELECT *, unnest(range(1, least(len(IDs_receivers_corr), len(q_calls_corr), len(residence_distance_km_corr), len(calls_duration_total_corr)) + 1)) AS i FROM dirty)""",
)
def edge_explode(spark, sf_dir):
    got = edges.explode_edges(fixtures.emitters(spark, sf_dir, dirty=True))
    return got.withColumn("avg_duration_per_call", F.round("avg_duration_per_call", 8))


@query(
    "edge_summary", S.EDGES, S.EMITTERS,
    select="""SELECT count(*) AS n_edges, count(DISTINCT id_emisor) AS n_emitters, count(DISTINCT id_receiver) AS n_receivers, count(*) - count(DISTINCT (id_emisor, id_receiver)) AS n_duplicate_pairs,
    CAST(sum(q_calls) AS BIGINT) AS calls_in_edges, (SELECT CAST(sum(total_calls_make) AS BIGINT) FROM emitters) AS calls_in_emitters FROM edges""",
)
def edge_summary(spark, sf_dir):
    return quality.edge_reconciliation(fixtures.edges(spark, sf_dir), fixtures.emitters(spark, sf_dir))


_DISTANCE = f"""SELECT axis.band, axis.label, coalesce(e, 0) AS edges, CAST(coalesce(c, 0) AS BIGINT) AS calls, round(coalesce(d, 0.0), 2) AS duration, median_calls, mean_calls,
    round(coalesce(e, 0) / CAST(sum(coalesce(e, 0)) OVER () AS DOUBLE), 9) AS edge_share, round(CAST(coalesce(c, 0) AS DOUBLE) / sum(coalesce(c, 0)) OVER (), 9) AS call_share
    FROM {S.axis(DISTANCE_BANDS)} LEFT JOIN (SELECT {S.band('residence_distance_km', DISTANCE_BANDS)} AS band, count(*) AS e, sum(q_calls) AS c, sum(calls_duration_total) AS d, median(q_calls) AS median_calls, round(avg(q_calls), 6) AS mean_calls
    FROM edges GROUP BY 1) g ON g.band = axis.band"""
_CALLS = f"""SELECT axis.band, axis.label, coalesce(e, 0) AS emitters, CAST(coalesce(c, 0) AS BIGINT) AS calls, median_receivers,
    round(coalesce(e, 0) / CAST(sum(coalesce(e, 0)) OVER () AS DOUBLE), 9) AS emitter_share, round(CAST(coalesce(c, 0) AS DOUBLE) / sum(coalesce(c, 0)) OVER (), 9) AS call_share
    FROM {S.axis(CALL_BANDS)} LEFT JOIN (SELECT {S.band('total_calls_make', CALL_BANDS)} AS band, count(*) AS e, sum(total_calls_make) AS c, median(unique_receivers) AS median_receivers FROM emitters GROUP BY 1) g ON g.band = axis.band"""


@query("distance_bands", S.EDGES, select=_DISTANCE)
def distance_bands(spark, sf_dir):
    return bands.distance_bands(fixtures.edges(spark, sf_dir))


@query("distance_bands_long", S.EDGES, select=f"SELECT band, label, 'edge_share' AS metric, edge_share AS share FROM ({_DISTANCE}) UNION ALL SELECT band, label, 'call_share', call_share FROM ({_DISTANCE})")
def distance_bands_long(spark, sf_dir):
    return bands.long_shares(bands.distance_bands(fixtures.edges(spark, sf_dir)), ["edge_share", "call_share"])


@query("emitter_bands", S.EDGES, S.EMITTERS, select=_CALLS)
def emitter_bands(spark, sf_dir):
    return bands.caller_bands(fixtures.emitters(spark, sf_dir))


@query("emitter_bands_long", S.EDGES, S.EMITTERS, select=f"SELECT band, label, 'emitter_share' AS metric, emitter_share AS share FROM ({_CALLS}) UNION ALL SELECT band, label, 'call_share', call_share FROM ({_CALLS})")
def emitter_bands_long(spark, sf_dir):
    return bands.long_shares(bands.caller_bands(fixtures.emitters(spark, sf_dir)), ["emitter_share", "call_share"])


@query("edge_ccdf", S.EDGES, select="SELECT id_emisor, id_receiver, q_calls AS value, round(1 - (row_number() OVER (ORDER BY q_calls, id_emisor, id_receiver) - 1) / CAST(count(*) OVER () AS DOUBLE), 9) AS survival FROM edges")
def edge_ccdf(spark, sf_dir):
    return profile.survival_by_row(fixtures.edges(spark, sf_dir), "q_calls", ["id_emisor", "id_receiver"])


# -- residences and antennas -------------------------------------------------------------------------------------------

_PEOPLE = ", people AS (SELECT id_emisor AS ID FROM edges UNION SELECT id_receiver FROM edges), multi AS (SELECT ID, count(*) AS degree FROM (SELECT id_emisor AS ID FROM edges UNION ALL SELECT id_receiver FROM edges) GROUP BY ID)"
_NO_RESIDENCE = ", lost AS (SELECT ID, degree FROM people JOIN multi USING (ID) WHERE ID NOT IN (SELECT ID FROM residences))"


def _residences(spark, sf_dir):
    return residence.normal_residences(fixtures.residences(spark, sf_dir))


@query(
    "missing_residence", S.EDGES, S.RESIDENCES,
    select=" UNION ALL ".join(f"SELECT '{r}' AS role, count(*) AS edge_rows, CAST(count_if({c} NOT IN (SELECT ID FROM residences)) AS BIGINT) AS n_missing, round(100.0 * count_if({c} NOT IN (SELECT ID FROM residences)) / count(*), 6) AS percent_missing FROM edges" for r, c in (("emitter", "id_emisor"), ("receiver", "id_receiver"))),
)
def missing_residence(spark, sf_dir):
    return residence.missing_residence(fixtures.edges(spark, sf_dir), _residences(spark, sf_dir))


@query("edge_people", S.EDGES + _PEOPLE, select="SELECT ID FROM people")
def edge_people(spark, sf_dir):
    return residence.edge_people(fixtures.edges(spark, sf_dir))


@query("missing_nodes", S.EDGES + _PEOPLE, S.RESIDENCES + _NO_RESIDENCE, select="SELECT ID FROM lost")
def missing_nodes(spark, sf_dir):
    return residence.missing_nodes(fixtures.edges(spark, sf_dir), _residences(spark, sf_dir))


@query("raw_multidegree", S.EDGES + _PEOPLE, select="SELECT ID, degree FROM multi")
def raw_multidegree(spark, sf_dir):
    return residence.raw_multidegree(fixtures.edges(spark, sf_dir))


@query("describe_multidegree", S.EDGES + _PEOPLE, select=S.describe("multi", ["degree"], [0.25, 0.5, 0.75]))
def describe_multidegree(spark, sf_dir):
    return profile.describe(residence.raw_multidegree(fixtures.edges(spark, sf_dir)), ["degree"])


@query("missing_degree_describe", S.EDGES + _PEOPLE, S.RESIDENCES + _NO_RESIDENCE, select=S.describe("lost", ["degree"], [0.25, 0.5, 0.75]))
def missing_degree_describe(spark, sf_dir):
    return profile.describe(residence.missing_multidegree(fixtures.edges(spark, sf_dir), _residences(spark, sf_dir)), ["degree"])


@query("missing_degree_top", S.EDGES + _PEOPLE, S.RESIDENCES + _NO_RESIDENCE, select="SELECT ID, degree FROM lost ORDER BY degree DESC, ID LIMIT 20")
def missing_degree_top(spark, sf_dir):
    return rankings.top(residence.missing_multidegree(fixtures.edges(spark, sf_dir), _residences(spark, sf_dir)), ["degree"], ["ID"], 20)


_ANTENNA_COLUMNS = "antenna_id, residence_geometry, residence_city, residence_quintile_state, residence_quintile_nation"


@query("antennas", S.EDGES, S.RESIDENCES, S.ANTENNAS, select=f"SELECT {_ANTENNA_COLUMNS} FROM antennas")
def antennas(spark, sf_dir):
    return residence.antennas(_residences(spark, sf_dir)).drop("geometry_key")


@query("antennas_city", S.EDGES, S.RESIDENCES, S.ANTENNAS, select=f"SELECT {_ANTENNA_COLUMNS} FROM antennas WHERE residence_city = 'ASIA'")
def antennas_city(spark, sf_dir):
    return residence.antennas_of_city(residence.antennas(_residences(spark, sf_dir)), "ASIA").drop("geometry_key")


_EA = "id_emisor, id_receiver, q_calls, residence_distance_km, calls_duration_total, round(avg_duration_per_call, 8) AS avg_duration_per_call, emissor_antenna_id, receptor_antenna_id"


@query("edges_antenna", S.EDGES, S.RESIDENCES, S.ANTENNAS, select=f"SELECT {_EA} FROM edges_antenna")
def edges_antenna(spark, sf_dir):
    return antenna_edges(spark, sf_dir).withColumn("avg_duration_per_call", F.round("avg_duration_per_call", 8))


@query("antenna_nulls", S.EDGES, S.RESIDENCES, S.ANTENNAS, select="SELECT CAST(count_if(emissor_antenna_id IS NULL) AS BIGINT) AS emissor_nulls, CAST(count_if(receptor_antenna_id IS NULL) AS BIGINT) AS receptor_nulls FROM edges_antenna")
def antenna_nulls(spark, sf_dir):
    return residence.antenna_nulls(antenna_edges(spark, sf_dir))


_MODE = ", roles AS (SELECT id_emisor AS user_id, emissor_antenna_id AS antenna_id FROM edges_antenna UNION ALL SELECT id_receiver, receptor_antenna_id FROM edges_antenna), user_antenna AS (SELECT user_id, antenna_id FROM (SELECT user_id, antenna_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, antenna_id) AS rn FROM roles GROUP BY user_id, antenna_id) WHERE rn = 1)"


@query("user_antenna_mode", S.EDGES, S.RESIDENCES, S.ANTENNAS + _MODE, select="SELECT user_id, antenna_id FROM user_antenna")
def user_antenna_mode(spark, sf_dir):
    return edges.user_antenna_mode(antenna_edges(spark, sf_dir))


# -- graph: one or two aggregates --------------------------------------------------------------------------------------


@query("undirected_edges", S.EDGES, S.GRAPH, select="SELECT source, target, q_calls, round(calls_duration_total, 4) AS calls_duration_total, round(avg_duration_per_call, 8) AS avg_duration_per_call, round(residence_distance_km, 6) AS residence_distance_km, round(weight, 6) AS weight FROM undirected")
def undirected(spark, sf_dir):
    u = edges.undirected_edges(fixtures.edges(spark, sf_dir))
    return u.withColumns({c: F.round(c, n) for c, n in (("calls_duration_total", 4), ("avg_duration_per_call", 8), ("residence_distance_km", 6), ("weight", 6))})


@query("density", S.SPARSE, S.GRAPH, select="SELECT n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 12) AS density FROM (SELECT count(*) AS n_nodes FROM nodes), (SELECT count(*) AS n_edges FROM undirected)")
def density(spark, sf_dir):
    return core.counts(sparse_graph(spark, sf_dir)).withColumn("density", F.round("density", 12))


@query("degree", S.SPARSE, S.GRAPH, select="SELECT node, degree FROM degrees")
def degree(spark, sf_dir):
    return core.degrees(sparse_graph(spark, sf_dir)).select("node", "degree")


@query("strength", S.SPARSE, S.GRAPH, select="SELECT node, strength FROM degrees")
def strength(spark, sf_dir):
    return core.degrees(sparse_graph(spark, sf_dir)).select("node", "strength")


@query("degree_describe", S.SPARSE, S.GRAPH, select=S.describe("degrees", ["degree"], [0.25, 0.5, 0.75]))
def degree_describe(spark, sf_dir):
    return profile.describe(core.degrees(sparse_graph(spark, sf_dir)), ["degree"])


@query("degree_ccdf", S.SPARSE, S.GRAPH, select="SELECT degree AS value, count(*) AS n_k, round(CAST(sum(count(*)) OVER (ORDER BY degree DESC) AS DOUBLE) / sum(count(*)) OVER (), 9) AS survival FROM degrees GROUP BY degree")
def degree_ccdf(spark, sf_dir):
    return profile.survival_by_value(core.degrees(sparse_graph(spark, sf_dir)), "degree")


@query("components", S.SPARSE, S.GRAPH, S.COMPONENTS, select="SELECT node, component FROM comps")
def components(spark, sf_dir):
    return core.components(sparse_graph(spark, sf_dir))


@query("component_sizes", S.SPARSE, S.GRAPH, S.COMPONENTS, select="SELECT component, size FROM sizes")
def component_sizes(spark, sf_dir):
    return core.component_sizes(core.components(sparse_graph(spark, sf_dir)))


@query("giant_share", S.SPARSE, S.GRAPH, S.COMPONENTS, select="SELECT count(*) AS n_components, max(size) AS giant_size, round(max(size) / CAST(sum(size) AS DOUBLE), 9) AS giant_share FROM sizes")
def giant_share(spark, sf_dir):
    return core.giant_share(core.components(sparse_graph(spark, sf_dir)))


_TRIANGLES = """, simple AS (SELECT source, target FROM undirected WHERE source <> target), sdeg AS (SELECT node, count(*) AS d FROM (SELECT source AS node FROM simple UNION ALL SELECT target FROM simple) GROUP BY node),
tri AS (SELECT x.source AS a, x.target AS b, y.target AS c FROM simple x JOIN simple y ON x.target = y.source JOIN simple z ON z.source = x.source AND z.target = y.target),
tn AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY node),
local AS (SELECT n.node, coalesce(d, 0) AS degree, coalesce(t, 0) AS triangles, coalesce(2.0 * t / nullif(d * (d - 1), 0), 0) AS clustering FROM nodes n LEFT JOIN sdeg ON sdeg.node = n.node LEFT JOIN tn ON tn.node = n.node)"""


@query("clustering_local", S.SPARSE, S.GRAPH + _TRIANGLES, select="SELECT node, degree, triangles, round(CAST(clustering AS DOUBLE), 9) AS clustering FROM local")
def clustering_local(spark, sf_dir):
    return clustering.local_clustering(sparse_graph(spark, sf_dir)).withColumn("clustering", F.round("clustering", 9))


@query("clustering_avg", S.SPARSE, S.GRAPH + _TRIANGLES, select="SELECT round(avg(CAST(clustering AS DOUBLE)), 9) AS average_clustering FROM local")
def clustering_avg(spark, sf_dir):
    return clustering.average_clustering(sparse_graph(spark, sf_dir))


@query("clustering_dense", S.DENSE, S.GRAPH + _TRIANGLES, select="SELECT round(avg(CAST(clustering AS DOUBLE)), 9) AS average_clustering FROM local")
def clustering_dense(spark, sf_dir):
    return clustering.average_clustering(dense_graph(spark, sf_dir))


@query(
    "assortativity", S.SPARSE, S.GRAPH, S.COMPONENTS,
    select="""SELECT round((sp / n - (s / n) * (s / n)) / (ss / n - (s / n) * (s / n)), 9) AS assortativity FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(a.degree) AS DOUBLE) AS s,
    CAST(sum(a.degree * a.degree) AS DOUBLE) AS ss, CAST(sum(a.degree * b.degree) AS DOUBLE) AS sp FROM gends JOIN gdegrees a ON a.node = gends.node JOIN gdegrees b ON b.node = gends.neighbour)""",
)
def assortativity(spark, sf_dir):
    return core.assortativity(sparse_giant(spark, sf_dir))


@query("knn", S.SPARSE, S.GRAPH, S.COMPONENTS, select="SELECT a.degree AS k, round(avg(b.degree), 9) AS mean_neighbour_degree FROM gends JOIN gdegrees a ON a.node = gends.node JOIN gdegrees b ON b.node = gends.neighbour GROUP BY a.degree")
def knn(spark, sf_dir):
    return core.neighbour_degree(sparse_giant(spark, sf_dir))


_FIT = """, starts AS (SELECT unnest(range(1, (SELECT max(k) FROM hist))) AS x_min), tail AS (SELECT x_min, k, n_k FROM starts JOIN hist ON k >= x_min),
fit AS (SELECT x_min, CAST(sum(n_k) AS BIGINT) AS n_tail, 1 + sum(n_k) / sum(n_k * ln(k / (x_min - CAST(0.5 AS DOUBLE)))) AS alpha FROM tail GROUP BY x_min HAVING sum(n_k) >= 30),
runs AS (SELECT x_min, n_tail, alpha, k, n_k, sum(n_k) OVER (PARTITION BY x_min ORDER BY k) AS cum FROM tail JOIN fit USING (x_min)),
gaps AS (SELECT x_min, n_tail, alpha, max(greatest(abs((cum - n_k + 1) / CAST(n_tail AS DOUBLE) - (1 - pow(k / CAST(x_min AS DOUBLE), -(alpha - 1)))), abs(cum / CAST(n_tail AS DOUBLE) - (1 - pow(k / CAST(x_min AS DOUBLE), -(alpha - 1)))))) AS ks FROM runs GROUP BY ALL),
best AS (SELECT * FROM gaps ORDER BY ks, x_min LIMIT 1)"""


@query("power_law", S.SPARSE, S.GRAPH, S.COMPONENTS + _FIT, select="SELECT x_min, n_tail, round(alpha, 9) AS alpha, round(ks, 9) AS ks FROM best")
def power_law(spark, sf_dir):
    got = powerlaw.power_law(core.degree_histogram(sparse_giant(spark, sf_dir)))
    return got.withColumns({"alpha": F.round("alpha", 9), "ks": F.round("ks", 9)})


@query(
    "power_law_curve", S.SPARSE, S.GRAPH, S.COMPONENTS + _FIT,
    select="""SELECT k, round(s, 9) AS survival, CASE WHEN k >= x_min THEN round(at_min * pow(k / CAST(x_min AS DOUBLE), -(alpha - 1)), 9) END AS fitted
    FROM (SELECT k, CAST(sum(n_k) OVER (ORDER BY k DESC) AS DOUBLE) / sum(n_k) OVER () AS s FROM hist), best,
    (SELECT CAST(sum(n_k) FILTER (WHERE k >= (SELECT x_min FROM best)) AS DOUBLE) / sum(n_k) AS at_min FROM hist)""",
)
def power_law_curve(spark, sf_dir):
    return powerlaw.power_law_curve(core.degree_histogram(sparse_giant(spark, sf_dir)))


_BLOCKS = ", part AS (SELECT node, CAST(node AS BIGINT) // 30 AS community FROM nodes)"


@query(
    "modularity", S.SPARSE, S.GRAPH + _BLOCKS,
    select="""SELECT round(sum(l / m - (k / (2 * m)) * (k / (2 * m))), 9) AS modularity FROM (SELECT community, sum(l) AS l, sum(k) AS k FROM
    (SELECT a.community, CASE WHEN a.community = b.community THEN weight ELSE 0 END AS l, weight AS k FROM undirected JOIN part a ON a.node = source JOIN part b ON b.node = target
     UNION ALL SELECT b.community, 0, weight FROM undirected JOIN part b ON b.node = target) GROUP BY community), (SELECT sum(weight) AS m FROM undirected)""",
)
def modularity(spark, sf_dir):
    g = sparse_graph(spark, sf_dir)
    return community.modularity(g, community.fixed_partition(g, 30)).withColumn("modularity", F.round("modularity", 9))


_TABLE = "SELECT community, count(*) AS community_size, row_number() OVER (ORDER BY count(*) DESC, community) AS community_rank FROM part GROUP BY community"


@query("community_table_fixed", S.SPARSE, S.GRAPH + _BLOCKS, select=f"SELECT node, part.community, community_size, community_rank FROM part JOIN ({_TABLE}) t ON t.community = part.community")
def community_table_fixed(spark, sf_dir):
    return community.community_table(community.fixed_partition(sparse_graph(spark, sf_dir), 30))


@query("community_top_sizes", S.SPARSE, S.GRAPH + _BLOCKS, select="SELECT community, count(*) AS community_size FROM part GROUP BY community ORDER BY community_size DESC, community LIMIT 20")
def community_top_sizes(spark, sf_dir):
    return community.top_sizes(community.fixed_partition(sparse_graph(spark, sf_dir), 30))


@query("top_degree_hubs", S.SPARSE, S.GRAPH, select="SELECT node, degree, strength FROM degrees ORDER BY degree DESC, node LIMIT 15")
def top_degree_hubs(spark, sf_dir):
    return rankings.top(core.degrees(sparse_graph(spark, sf_dir)), ["degree"], ["node"])


@query("self_loops", S.EDGES, S.GRAPH, select="SELECT count(*) FILTER (WHERE source = target) AS n_loops, count(*) FILTER (WHERE source <> target) AS n_edges FROM undirected")
def self_loops(spark, sf_dir):
    return edges.undirected_edges(fixtures.edges(spark, sf_dir)).agg(F.count_if(F.expr("source = target")).alias("n_loops"), F.count_if(F.expr("source <> target")).alias("n_edges"))


# -- graph: iterations -------------------------------------------------------------------------------------------------


#: Rounds that the unrolled SQL takes; further ones change nothing on these graphs.
_ROUNDS, _DEPTH = 40, 40


def _cores() -> str:
    out = [", c0 AS MATERIALIZED (SELECT node, CAST(count(*) AS BIGINT) AS core FROM gends GROUP BY node)"]
    for i in range(_ROUNDS):
        out.append(
            f"c{i + 1} AS MATERIALIZED (SELECT node, CAST(max(least(c, rn)) AS BIGINT) AS core FROM (SELECT g.node, c.core AS c, row_number() OVER (PARTITION BY g.node ORDER BY c.core DESC) AS rn "
            f"FROM gends g JOIN c{i} c ON c.node = g.neighbour) GROUP BY node)"
        )
    return ", ".join([*out, f"cores AS (SELECT node, core FROM c{_ROUNDS})"])


def _levels() -> str:
    """Breadth first: l_i holds the pairs (root, node) at distance i."""
    out = [", l0 AS MATERIALIZED (SELECT node AS root, node FROM (SELECT node FROM gnodes ORDER BY md5(node || ':42'), node LIMIT 500))", "l_none AS (SELECT * FROM l0 WHERE FALSE)"]
    for i in range(_DEPTH):
        before = f"l{i - 1}" if i else "l_none"
        out.append(
            f"l{i + 1} AS MATERIALIZED (SELECT DISTINCT root, neighbour AS node FROM l{i} JOIN gends USING (node) WHERE (root, neighbour) NOT IN (SELECT (root, node) FROM l{i}) "
            f"AND (root, neighbour) NOT IN (SELECT (root, node) FROM {before}))"
        )
    return ", ".join([*out, "far AS (" + " UNION ALL ".join(f"SELECT {i} AS depth, count(*) AS n FROM l{i}" for i in range(1, _DEPTH + 1)) + ")"])


def _removal(order: str) -> str:
    """Giant share after removing the first nodes of an order; alive: (step, node)."""
    return f""", total AS (SELECT count(*) AS n FROM gnodes), axis AS (SELECT CAST(i AS INTEGER) AS step, CAST(0.6 AS DOUBLE) * i / 24 AS fraction FROM (SELECT unnest(range(25)) AS i)),
    removal AS (SELECT node, row_number() OVER (ORDER BY {order}) AS place FROM (SELECT node, coalesce(degree, 0) AS degree FROM gnodes LEFT JOIN gdegrees USING (node))),
    alive AS (SELECT step, node FROM axis, total, removal WHERE place > CAST(floor(fraction * n) AS BIGINT)),
    links AS (SELECT a.step, a.node, b.node AS neighbour FROM alive a JOIN gends USING (node) JOIN alive b ON b.step = a.step AND b.node = gends.neighbour),
    spread(step, a, b) AS (SELECT step, node, node FROM alive UNION SELECT spread.step, a, neighbour FROM spread JOIN links ON links.step = spread.step AND links.node = b),
    biggest AS (SELECT step, max(size) AS size FROM (SELECT step, a, count(*) AS size FROM spread GROUP BY step, a) GROUP BY step)"""


_CURVE = "SELECT step, round(fraction, 9) AS fraction, round(CAST(coalesce(size, 0) AS DOUBLE) / n, 9) AS giant_fraction FROM axis LEFT JOIN biggest USING (step), total"
_DENSE_GIANT = [S.DENSE, S.GRAPH, S.COMPONENTS]
_SPARSE_GIANT = [S.SPARSE, S.GRAPH, S.COMPONENTS]


@query("core_number", *_DENSE_GIANT[:2], S.COMPONENTS + _cores(), select="SELECT node, core FROM cores")
def core_number(spark, sf_dir):
    return dense_cores(spark, sf_dir)


@query("core_sizes", *_DENSE_GIANT[:2], S.COMPONENTS + _cores(), select="SELECT k, (SELECT count(*) FROM cores WHERE core >= k) AS size FROM (SELECT unnest(range(0, (SELECT max(core) FROM cores) + 1)) AS k)")
def core_sizes(spark, sf_dir):
    return kcore.core_sizes(dense_cores(spark, sf_dir))


@query("core_histogram", *_DENSE_GIANT[:2], S.COMPONENTS + _cores(), select="SELECT value, (SELECT count(*) FROM cores WHERE core = value) AS n FROM (SELECT unnest(range(0, (SELECT max(core) FROM cores) + 1)) AS value)")
def core_histogram(spark, sf_dir):
    return profile.integer_histogram(dense_cores(spark, sf_dir), "core")


@query("core_nucleus", *_DENSE_GIANT[:2], S.COMPONENTS + _cores(), select="SELECT core AS k_max, count(*) AS size FROM cores GROUP BY core ORDER BY core DESC LIMIT 1")
def core_nucleus(spark, sf_dir):
    return kcore.nucleus(dense_cores(spark, sf_dir))


@query("path_length", *_DENSE_GIANT[:2], S.COMPONENTS + _levels(), select="SELECT CAST(sum(depth * n) AS BIGINT) AS distance, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(depth * n) AS DOUBLE) / sum(n) AS mean_path FROM far")
def path_length(spark, sf_dir):
    return paths.mean_path_length(dense_ties(spark, sf_dir))


@query("betweenness")
def betweenness(spark, sf_dir):
    return paths.betweenness(dense_component(spark, sf_dir))


@query("eigenvector")
def eigenvector(spark, sf_dir):
    return centrality.eigenvector(dense_giant(spark, sf_dir))


@query("top_hubs")
def top_hubs(spark, sf_dir):
    return rankings.top(centrality.centralities(dense_giant(spark, sf_dir)), ["degree"], ["node"])


@query("louvain")
def louvain(spark, sf_dir):
    return dense_communities(spark, sf_dir)


@query("community_table")
def community_table(spark, sf_dir):
    return community.community_table(dense_communities(spark, sf_dir))


@query("community_sizes")
def community_sizes(spark, sf_dir):
    return community.community_sizes(dense_communities(spark, sf_dir))


@query("louvain_modularity")
def louvain_modularity(spark, sf_dir):
    g = dense_giant(spark, sf_dir)
    return community.modularity(g, dense_communities(spark, sf_dir))


@query("random_graph", *_SPARSE_GIANT, select="SELECT n_nodes, n_edges, 2.0 * n_edges / (CAST(n_nodes AS DOUBLE) * (n_nodes - 1)) AS density FROM (SELECT (SELECT count(*) FROM gnodes) AS n_nodes, (SELECT count(*) // 2 FROM gends) AS n_edges)")
def random_graph_(spark, sf_dir):
    g = sparse_giant(spark, sf_dir)
    return core.counts(random_graph.gnm(spark, g.vertices.count(), g.edges.count()))


@query("small_world")
def small_world(spark, sf_dir):
    return random_graph.small_world(dense_giant(spark, sf_dir).without_loops())


@query("robustness_attack", *_SPARSE_GIANT[:2], S.COMPONENTS + _removal("degree DESC, node"), select=_CURVE)
def robustness_attack(spark, sf_dir):
    g = sparse_giant(spark, sf_dir)
    return robustness.giant_fraction_curve(g, robustness.attack_order(g))


@query("robustness_random", *_SPARSE_GIANT[:2], S.COMPONENTS + _removal("md5(node || ':1'), node"), select=_CURVE)
def robustness_random(spark, sf_dir):
    g = sparse_giant(spark, sf_dir)
    return robustness.giant_fraction_curve(g, robustness.failure_order(g))


# -- extensions --------------------------------------------------------------------------------------------------------


@query("distance_decay", S.EDGES, select=f"SELECT {S.band('residence_distance_km', DISTANCE_BANDS)} AS band, count(*) AS edges, round(avg(q_calls), 6) AS mean_calls, round(avg(calls_duration_total), 4) AS mean_duration FROM edges WHERE residence_distance_km IS NOT NULL GROUP BY 1")
def distance_decay(spark, sf_dir):
    return spatial.distance_decay(fixtures.edges(spark, sf_dir))


_QUINTILES = ", qc AS (SELECT a.residence_quintile_nation AS q_from, b.residence_quintile_nation AS q_to, sum(q_calls) AS calls FROM edges JOIN residences a ON a.ID = id_emisor JOIN residences b ON b.ID = id_receiver GROUP BY 1, 2)"


@query("quintile_mixing", S.EDGES, S.RESIDENCES + _QUINTILES, select="SELECT q_from, " + ", ".join(f"round(CAST(coalesce(sum(calls) FILTER (WHERE q_to = '{q}'), 0) AS DOUBLE) / sum(calls), 9) AS {q}" for q in spatial.QUINTILES) + " FROM qc GROUP BY q_from")
def quintile_mixing(spark, sf_dir):
    return spatial.quintile_mixing(fixtures.edges(spark, sf_dir), _residences(spark, sf_dir))


@query(
    "quintile_homophily", S.EDGES, S.RESIDENCES + _QUINTILES,
    select="""SELECT round(CAST(sum(calls) FILTER (WHERE q_from = q_to) AS DOUBLE) / sum(calls), 9) AS observed, round((SELECT sum(CAST(o AS DOUBLE) / t * i / t) FROM (SELECT q_from AS q, sum(calls) AS o FROM qc GROUP BY 1)
    JOIN (SELECT q_to AS q, sum(calls) AS i FROM qc GROUP BY 1) USING (q), (SELECT CAST(sum(calls) AS DOUBLE) AS t FROM qc)), 9) AS expected FROM qc""",
)
def quintile_homophily(spark, sf_dir):
    return spatial.quintile_homophily(fixtures.edges(spark, sf_dir), _residences(spark, sf_dir))


@query("antenna_flow", S.EDGES, S.RESIDENCES, S.ANTENNAS, select="SELECT emissor_antenna_id, receptor_antenna_id, CAST(sum(q_calls) AS BIGINT) AS calls, count(*) AS edges FROM edges_antenna GROUP BY 1, 2")
def antenna_flow(spark, sf_dir):
    return spatial.antenna_flow(antenna_edges(spark, sf_dir))


@query("antenna_communities", S.SPARSE, S.GRAPH + _BLOCKS, S.RESIDENCES, S.ANTENNAS + _MODE, select="SELECT antenna_id, community, count(*) AS people FROM part JOIN user_antenna ON user_id = node GROUP BY 1, 2")
def antenna_communities(spark, sf_dir):
    parts = community.fixed_partition(sparse_graph(spark, sf_dir), 30)
    return spatial.antenna_communities(parts, edges.user_antenna_mode(antenna_edges(spark, sf_dir, "sparse")))


# -- stores ------------------------------------------------------------------------------------------------------------


@query("edges_reload", S.EDGES, select="SELECT id_emisor, id_receiver, q_calls, residence_distance_km, calls_duration_total, round(avg_duration_per_call, 8) AS avg_duration_per_call FROM edges")
def edges_reload(spark, sf_dir):
    """S2, S4, S5, S8-S10. Written once, then read again with the declared schema."""
    path = scratch_path(spark, "edges")
    for _ in range(2):
        out = tables.reload(spark, path, tables.EDGES, lambda: fixtures.edges(spark, sf_dir))
    return out.withColumn("avg_duration_per_call", F.round("avg_duration_per_call", 8))


@query("residences_csv", S.EDGES, S.RESIDENCES, select="SELECT ID, residence_geometry, residence_city, residence_quintile_state, residence_quintile_nation FROM residences")
def residences_csv(spark, sf_dir):
    """S1, S6, S7, P13. Residences through CSV, a helper column left out."""
    city = tables.CityConfig("test", "emitters.parquet", scratch_path(spark, "city"))
    tables.write_csv(fixtures.residences(spark, sf_dir).withColumn("helper", F.lit(1)), city.path(city.residences_file), drop=("helper",))
    return tables.read_residences(spark, city.path(city.residences_file))


@query("table_presence", select="SELECT name, name <> 'calls' AS present FROM (VALUES ('customer'), ('orders'), ('lineitem'), ('calls')) AS t(name)")
def table_presence(spark, sf_dir):
    """S2."""
    rows = [(t, tables.exists(spark, f"{sf_dir}/{t}.parquet")) for t in ("customer", "orders", "lineitem", "calls")]
    return spark.createDataFrame(rows, "name string, present boolean")


@query("pareto_top", S.EDGES, S.EMITTERS, select="SELECT id_emisor, total_calls_make, row_number() OVER (ORDER BY total_calls_make DESC, id_emisor) AS rank FROM emitters ORDER BY rank LIMIT 10")
def pareto_top(spark, sf_dir):
    """T5."""
    return rankings.pareto_curve(fixtures.emitters(spark, sf_dir)).orderBy("rank").limit(10).select("id_emisor", "total_calls_make", "rank")


@query("rebuilt_network", S.EDGES, S.RESIDENCES, S.ANTENNAS.replace("edges_antenna AS (", "placed AS ("), S.GRAPH.replace("FROM edges GROUP", "FROM placed GROUP"), select="SELECT n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 12) AS density FROM (SELECT count(*) AS n_nodes FROM nodes), (SELECT count(*) AS n_edges FROM undirected)")
def rebuilt_network(spark, sf_dir):
    """D1. From the written edge table with antennas to the graph."""
    path = scratch_path(spark, "edges_antenna")
    read = tables.reload(spark, path, tables.EDGES_ANTENNA, lambda: antenna_edges(spark, sf_dir))
    g = core.Graph.from_edges(materialize(edges.undirected_edges(read), "undirected"))
    return core.counts(g).withColumn("density", F.round("density", 12))


#: Points (1, 2), with an SRID (-3.5, 0.25), and a line, which has no point.
_WKB = ["0101000000000000000000F03F0000000000000040", "0101000020E61000000000000000000CC0000000000000D03F", "010200000000000000"]


@query("geometry_points", select="SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN -3.5 END::DOUBLE AS x, CASE n_nationkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 0.25 END::DOUBLE AS y FROM nation")
def geometry_points(spark, sf_dir):
    """D2."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    texts = nations.withColumn("text", F.element_at(F.array(*[F.lit(x) for x in _WKB], F.lit(None).cast("string")), (F.col("n_nationkey") % 4 + 1).cast("int")))
    return texts.select("n_nationkey", spatial.wkb_point("text").alias("p")).select("n_nationkey", "p.x", "p.y")


@query(
    "nearest_antenna",
    select="""SELECT id, antenna_id FROM (SELECT c_custkey AS id, s_suppkey AS antenna_id, row_number() OVER (PARTITION BY c_custkey ORDER BY (s_suppkey * 7 % 97 - c_custkey % 97) * (s_suppkey * 7 % 97 - c_custkey % 97)
    + (s_suppkey * 13 % 89 - c_custkey % 89) * (s_suppkey * 13 % 89 - c_custkey % 89), s_suppkey) AS rn FROM customer, supplier) WHERE rn = 1""",
)
def nearest_antenna(spark, sf_dir):
    """D3."""
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97).cast("double").alias("x"), (F.col("c_custkey") % 89).cast("double").alias("y"))
    antennas = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("antenna_id"), (F.col("s_suppkey") * 7 % 97).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 89).cast("double").alias("y"))
    return spatial.nearest_antenna(points, antennas)


@query("hub_antennas", S.SPARSE, S.GRAPH, S.RESIDENCES, S.ANTENNAS + _MODE, select="SELECT node, degree, antenna_id FROM (SELECT node, degree FROM degrees ORDER BY degree DESC, node LIMIT 15) LEFT JOIN user_antenna ON user_id = node")
def hub_antennas(spark, sf_dir):
    """D4."""
    hubs = rankings.top(core.degrees(sparse_graph(spark, sf_dir)), ["degree"], ["node"]).select("node", "degree")
    return spatial.hub_antennas(hubs, edges.user_antenna_mode(antenna_edges(spark, sf_dir, "sparse")))
