"""The same results in SQL, over the test tables. Each query is the derivations below and a final SELECT."""

from __future__ import annotations


FAR = "(l_partkey * 7 + l_suppkey * 13) % (SELECT count(*) FROM customer)"
BLOCK = "(o_custkey // 30) * 30"


def _edges(receiver: str) -> str:
    return f"""
edges_pairs AS (
  SELECT o_custkey AS s, {receiver} AS r,
         CAST(sum(l_linenumber) AS BIGINT) AS q, round(sum(l_extendedprice), 2) AS duration,
         min(round(l_tax * CAST(100.0 AS DOUBLE) + l_discount * CAST(50.0 AS DOUBLE), 4)) AS km
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
edges AS (
  SELECT CAST(s AS VARCHAR) AS id_emisor, CAST(r AS VARCHAR) AS id_receiver, q AS q_calls, km AS residence_distance_km,
         duration AS calls_duration_total, duration / q AS avg_duration_per_call FROM edges_pairs)"""


EDGES = _edges(f"CASE WHEN l_linenumber <= 5 THEN {BLOCK} + ((l_partkey % 30) * (l_partkey % 30)) // 30 ELSE {FAR} END")
SPARSE = _edges(
    f"""CASE WHEN l_linenumber = 7 AND l_partkey % 200 = 0 THEN {FAR} WHEN l_partkey % 2 = 0 THEN {BLOCK} + (o_custkey % 30) // 2
                                    ELSE {BLOCK} + ((o_custkey % 30) * (o_custkey % 30)) // 30 END"""
)
DENSE = _edges(f"CASE WHEN l_linenumber > 5 AND l_partkey % 8 = 0 THEN {FAR} ELSE {BLOCK} + ((l_partkey % 6) * (l_partkey % 6) * 25) // 30 END")
EMITTERS = """
emitters AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id_emisor, c_custkey AS key, CAST(coalesce(sum(q), 0) AS BIGINT) AS total_calls_make,
         CAST(count(r) AS BIGINT) AS unique_receivers,
         coalesce(list(CAST(r AS VARCHAR) ORDER BY r) FILTER (WHERE r IS NOT NULL), []) AS IDs_receivers_corr,
         coalesce(list(q ORDER BY r) FILTER (WHERE r IS NOT NULL), []) AS q_calls_corr,
         coalesce(list(km ORDER BY r) FILTER (WHERE r IS NOT NULL), []) AS residence_distance_km_corr,
         coalesce(list(duration ORDER BY r) FILTER (WHERE r IS NOT NULL), []) AS calls_duration_total_corr
  FROM customer LEFT JOIN edges_pairs ON s = c_custkey GROUP BY c_custkey)"""
DIRTY = """
dirty AS (
  SELECT * REPLACE (CASE WHEN key % 41 = 0 THEN total_calls_make + 1 ELSE total_calls_make END AS total_calls_make,
                    CASE WHEN key % 53 = 0 AND len(calls_duration_total_corr) > 0
                         THEN calls_duration_total_corr[1:len(calls_duration_total_corr) - 1] ELSE calls_duration_total_corr END AS calls_duration_total_corr)
  FROM emitters)"""
RESIDENCES = """
residences AS (
  SELECT CAST(c_custkey AS VARCHAR) AS ID, CASE WHEN c_custkey % 97 <> 0 THEN 'cell_' || CAST(c_custkey // 30 AS VARCHAR) END AS residence_geometry,
         r_name AS residence_city, 'q' || CAST(ntile(5) OVER (PARTITION BY r_name ORDER BY c_acctbal, c_custkey) AS VARCHAR) AS residence_quintile_state,
         'q' || CAST(ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS VARCHAR) AS residence_quintile_nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 13 <> 0)"""
ANTENNAS = """
keyed AS (SELECT *, coalesce(residence_geometry, '<NA>') AS geometry_key FROM residences),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geometry_key ORDER BY ID) AS rn FROM keyed) WHERE rn = 1),
antennas AS (SELECT CAST(dense_rank() OVER (ORDER BY geometry_key) AS BIGINT) AS antenna_id, geometry_key, residence_geometry, residence_city,
                    residence_quintile_state, residence_quintile_nation FROM firsts),
person AS (SELECT ID, antenna_id FROM keyed JOIN antennas USING (geometry_key)),
edges_antenna AS (SELECT edges.*, a.antenna_id AS emissor_antenna_id, b.antenna_id AS receptor_antenna_id
                  FROM edges JOIN person a ON a.ID = id_emisor JOIN person b ON b.ID = id_receiver)"""
GRAPH = """
undirected AS (
  SELECT least(id_emisor, id_receiver) AS source, greatest(id_emisor, id_receiver) AS target, CAST(sum(q_calls) AS BIGINT) AS q_calls,
         sum(calls_duration_total) AS calls_duration_total, avg(avg_duration_per_call) AS avg_duration_per_call, avg(residence_distance_km) AS residence_distance_km,
         ln(1 + sum(q_calls)) * ln(1 + sum(calls_duration_total)) AS weight
  FROM edges GROUP BY 1, 2),
nodes AS (SELECT source AS node FROM undirected UNION SELECT target FROM undirected),
ends AS (SELECT source AS node, target AS neighbour, q_calls, weight FROM undirected UNION ALL SELECT target, source, q_calls, weight FROM undirected),
degrees AS (SELECT node, count(*) AS degree, CAST(sum(q_calls) AS BIGINT) AS strength FROM ends GROUP BY node)"""
COMPONENTS = """
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, ends.neighbour FROM reach JOIN ends ON reach.b = ends.node),
comps AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
sizes AS (SELECT component, count(*) AS size FROM comps GROUP BY component),
largest AS (SELECT component FROM sizes ORDER BY size DESC, component LIMIT 1),
gnodes AS (SELECT node FROM comps WHERE component = (SELECT component FROM largest)),
gends AS (SELECT ends.* FROM ends WHERE node <> neighbour AND node IN (SELECT node FROM gnodes)),
gdegrees AS (SELECT node, count(*) AS degree FROM gends GROUP BY node),
hist AS (SELECT degree AS k, count(*) AS n_k FROM gdegrees GROUP BY degree)"""


def with_(*parts: str, select: str) -> str:
    return ("WITH RECURSIVE " + ",".join(parts) + "\n" if parts else "") + select.strip()


def describe(table: str, columns: list[str], percentiles: list[float]) -> str:
    p = ", ".join(f"round(quantile_cont(CAST({{c}} AS DOUBLE), {q}), 6) AS p{round(100 * q):02d}" for q in percentiles)
    one = f"SELECT '{{c}}' AS metric, count({{c}}) AS n, round(avg({{c}}), 6) AS mean, round(stddev_samp({{c}}), 6) AS std, CAST(min({{c}}) AS DOUBLE) AS min, {p}, CAST(max({{c}}) AS DOUBLE) AS max FROM {table}"
    return " UNION ALL ".join(one.replace("{c}", c) for c in columns)


def histogram(table: str, value: str, bins: int) -> str:
    return f"""
, x AS (SELECT CAST({value} AS DOUBLE) AS x FROM {table}), lim AS (SELECT min(x) AS a, max(x) AS b FROM x WHERE x IS NOT NULL),
e AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM lim WHERE a IS NOT NULL),
c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins} - 1) AS INTEGER) AS bin, count(*) AS c FROM x, e WHERE x IS NOT NULL GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) / {bins} * g.bin, 6) AS lower, round(lo + (hi - lo) / {bins} * (g.bin + 1), 6) AS upper, coalesce(c.c, 0) AS n
FROM e, (SELECT unnest(range({bins})) AS bin) g LEFT JOIN c ON c.bin = g.bin"""


def band(column: str, bands: list[tuple[float | None, str]]) -> str:
    whens = " ".join(f"WHEN {column} <= {u} THEN {i}" for i, (u, _) in enumerate(bands) if u is not None)
    return f"CASE WHEN {column} IS NULL THEN NULL {whens} ELSE {len(bands) - 1} END"


def axis(bands: list[tuple[float | None, str]]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{label}')" for i, (_, label) in enumerate(bands)) + ") AS axis(band, label)"
