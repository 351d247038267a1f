"""A network, trips and observations derived from the driver's tables, by one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Nodes, one for each supplier: the network grows with the tables.
NODES = "(SELECT count(*) FROM {supplier})"
#: From each node an edge to the next one and one to three times its number: any two nodes are some log3(n) + 10 edges apart.
EDGES = f"""(SELECT CAST(e AS BIGINT) AS edge_id, CAST(s AS BIGINT) AS source, CAST(t AS BIGINT) AS target, 500e0 + 100e0 * (e % 7) AS length, 8e0 + (e % 5) AS speed,
  1e0 + (e % 3) AS lanes, 0.2e0 + 0.1e0 * (e % 4) AS flow, 2e0 * (e % 2) AS constant_travel_time
  FROM (SELECT 2 * s_suppkey AS e, s_suppkey AS s, (s_suppkey + 1) % {NODES} AS t FROM {{supplier}}
        UNION ALL SELECT 2 * s_suppkey + 1, s_suppkey, (CASE WHEN (2 * s_suppkey + 5) % {NODES} = 0 OR (2 * s_suppkey + 4) % {NODES} = 0 THEN s_suppkey + 3 ELSE 3 * s_suppkey + 5 END) % {NODES} FROM {{supplier}}) raw_edges)"""
GRID = f"""(SELECT edge_id, source, target, CAST(n_nationkey AS BIGINT) AS k, 3600e0 * n_nationkey AS x, 60e0 + 10e0 * ((edge_id * 3 + n_nationkey * 7) % 11) AS y,
  40e0 + 25e0 * ((edge_id * 5 + n_nationkey * 3) % 7) AS y2, 1000e0 * ((edge_id * 3 + n_nationkey * 7) % 11) AS steep FROM {EDGES} grid_edges CROSS JOIN {{nation}})"""
REQUESTS = f"(SELECT o_orderkey AS request_id, o_orderkey % (2 * {NODES}) AS edge_id, CAST((o_orderkey * 37) % 86400 AS DOUBLE) AS t FROM {{orders}})"
ALTERNATIVES = """(SELECT c_custkey AS agent_id, CAST(n_nationkey AS BIGINT) AS alt, CAST((c_custkey * 7 + n_nationkey * 13) % 5 AS DOUBLE) AS v,
  CAST((c_custkey * 11 + n_nationkey * 29) % 17 AS DOUBLE) / 4e0 AS w, CAST((c_custkey * 7919) % 10000 AS DOUBLE) / 10000e0 AS u, 1e0 + (c_custkey % 3) AS mu
  FROM {customer} CROSS JOIN {nation} WHERE n_nationkey < 5)"""
VEHICLES = """(SELECT s_suppkey AS vehicle_id, CAST(s_nationkey % 3 AS BIGINT) AS kind, 7e0 + (s_nationkey % 5) AS upper_bound, 0.5e0 + 0.25e0 * (s_nationkey % 3) AS coef,
  CAST(s_nationkey % 4 AS BIGINT) AS banned FROM {supplier})"""
TRIPS = f"""(SELECT o_orderkey AS trip_id, o_custkey AS agent_id, (c_nationkey * 7 + o_custkey) % {NODES} AS origin, o_orderkey % {NODES} AS destination, o_orderkey % 2 AS uvehicle, o_orderkey % 3 AS dt_kind,
  CAST((o_orderkey * 37) % 86400 AS DOUBLE) AS departure FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey)"""
ROUTES = f"""(SELECT l_orderkey AS trip_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS position, l_partkey % (2 * {NODES}) AS edge_id, l_suppkey % (2 * {NODES}) AS other_edge, l_quantity * 60e0 AS spent FROM {{lineitem}})"""
OBSERVED = f"""(SELECT event_id, user_id % (2 * {NODES}) AS edge_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS DOUBLE) AS t, value * 1.000037e0 AS y FROM {{events}})"""
UTILITIES = """(SELECT c_custkey AS agent_id, CAST(n_nationkey AS BIGINT) AS k, 900e0 * n_nationkey AS x, -CAST((c_custkey * 13 + n_nationkey * 29) % 17 AS DOUBLE) / 2e0 AS y,
  CAST((c_custkey * 7919) % 10000 AS DOUBLE) / 10000e0 AS u, 1e0 + (c_custkey % 3) AS mu FROM {customer} CROSS JOIN {nation} WHERE n_nationkey < 9)"""


#: Trips over seven layers of roads, a road for each supplier in each: what a layer's road does depends on the layers before alone.
LAYERS = 7
LAYER_EDGES = f"""(SELECT CAST(layer * {NODES} + s_suppkey AS BIGINT) AS edge_id, 300e0 + 0.37e0 * ((s_suppkey * 53 + layer * 29) % 997) AS length, 10e0 + (s_suppkey % 4) AS speed, 1e0 + (s_suppkey % 2) AS lanes,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 0.0009e0 + 0.000007e0 * ((s_suppkey * 37 + layer * 11) % 101) END AS flow FROM {{supplier}} CROSS JOIN (SELECT n_nationkey AS layer FROM {{nation}} WHERE n_nationkey < {LAYERS}) layers)"""
LAYER_ROUTES = f"""(SELECT l_orderkey AS trip_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS position,
  CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) * {NODES} + l_suppkey % {NODES} AS BIGINT) AS edge_id FROM {{lineitem}})"""


#: Roads of the first three layers without gates, whose speed depends on how full they are by one of three rules.
DENSE_LAYERS = 3
DENSE_EDGES = f"""(SELECT *, CASE (edge_id % {NODES}) % 3 WHEN 0 THEN 'FreeFlow' WHEN 1 THEN 'Bottleneck' ELSE 'ThreeRegimes' END AS kind FROM {LAYER_EDGES} e WHERE edge_id < {DENSE_LAYERS} * {NODES})"""


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The derived table as a DataFrame; only the tables it names are read."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\{{{t}\}}", text)}
    return spark.sql(f"SELECT * FROM {text} derived", **used)


def sql(text: str) -> str:
    """The same text over the views of the other engine."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
