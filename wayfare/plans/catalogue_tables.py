"""Queries of sources, rules and sinks: tables go to files and come back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.operators import network
from wayfare.plans import derived as d
from wayfare.plans import routing_job
from wayfare.plans.catalogue import query, r6
from wayfare.sources import files, sinks, tables
from wayfare.sources.shared import shared_dir


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _file(df: DataFrame, name: str, kind: str) -> str:
    """The table as a file of that kind, as a user would bring it."""
    path = f"{_folder(df.sparkSession)}/{name}.{kind}"
    if kind == "csv":
        df.write.option("header", True).csv(path)
    else:
        df.write.parquet(path)
    return path


def _back(spark, df: DataFrame, name: str, kind: str, table: str) -> DataFrame:
    return tables.read(tables.scan(spark, _file(df, name, kind)), table)


_EDGE_ROWS = "SELECT edge_id, source, target, speed, length, 1e0 AS lanes, constant_travel_time, TRUE AS overtaking, 'FreeFlow' AS speed_density_type FROM <EDGES> e"


def _edges(kind: str):
    def run(spark, sf_dir):
        given = d.frame(spark, sf_dir, d.EDGES).select("edge_id", "source", "target", "speed", "length", "constant_travel_time")
        return _back(spark, given, "edges", kind, "edges").select("edge_id", "source", "target", "speed", "length", "lanes", "constant_travel_time", "overtaking", "speed_density_type")

    return run


for _kind in ("csv", "parquet"):
    _f = _edges(_kind)
    _f.__name__ = f"read_edges_{_kind}"
    query(_EDGE_ROWS)(_f)


@query("SELECT c_custkey AS agent_id, CASE WHEN c_custkey % 2 = 0 THEN 'Logit' END AS alt_choice_type, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 10) / 10e0 END AS alt_choice_u, CASE WHEN c_custkey % 2 = 0 THEN 2e0 END AS alt_choice_mu FROM customer")
def read_agents(spark, sf_dir):
    """Agents whose choice is a struct."""
    key = F.col("c_custkey")
    even = key % 2 == 0
    choice = F.struct(F.lit("Logit").alias("type"), (key % 10 / 10.0).alias("u"), F.lit(2).alias("mu"))
    given = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.cast("int").alias("agent_id"), F.when(even, choice).alias("alt_choice"))
    return _back(spark, given, "agents", "parquet", "agents").select("agent_id", "alt_choice_type", "alt_choice_u", "alt_choice_mu")


@query(
    """SELECT c_custkey::VARCHAR AS agent_id, 'a' AS alt_id, 0e0 AS origin_delay, 'Discrete' AS dt_choice_type, 60e0 * (1 + c_custkey % 5) AS dt_choice_interval, 0e0 AS dt_choice_offset, TRUE AS pre_compute_route,
  CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE c_custkey * 1e0 END AS constant_utility FROM customer"""
)
def read_alternatives(spark, sf_dir):
    """Alternatives in flat columns with dots, ids as text, nulls at their defaults."""
    key = F.col("c_custkey")
    given = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.cast("string").alias("agent_id"), F.lit("a").alias("alt_id"), F.lit("Discrete").alias("dt_choice.type"), (60 * (1 + key % 5)).alias("dt_choice.interval"), F.when(key % 3 != 0, key).alias("constant_utility"),
    )
    got = _back(spark, given, "alternatives", "parquet", "alternatives")
    return got.select("agent_id", "alt_id", "origin_delay", "dt_choice_type", "dt_choice_interval", "dt_choice_offset", "pre_compute_route", "constant_utility")


@query("SELECT agent_id, 0::BIGINT AS alt_id, trip_id, 'Road' AS class_type, origin AS class_origin, destination AS class_destination, uvehicle AS class_vehicle, 0e0 AS stopping_time, origin * 10 + 1 AS first_edge FROM <TRIPS> t")
def read_trips(spark, sf_dir):
    """Trips with a struct of their class, routes as lists."""
    t = d.frame(spark, sf_dir, d.TRIPS)
    kind = F.struct(F.lit("Road").alias("type"), "origin", "destination", F.col("uvehicle").alias("vehicle"), F.array(F.col("origin") * 10 + 1, F.col("destination")).alias("route"))
    got = _back(spark, t.select("agent_id", F.lit(0).alias("alt_id"), "trip_id", kind.alias("class")), "trips", "parquet", "trips")
    return got.select("agent_id", "alt_id", "trip_id", "class_type", "class_origin", "class_destination", "class_vehicle", "stopping_time", F.get("class_route", F.lit(0)).alias("first_edge"))


@query("SELECT vehicle_id, 7e0 AS headway, 1e0 AS pce, CASE kind WHEN 0 THEN 'UpperBound' ELSE 'Base' END AS speed_function_type, CASE kind WHEN 0 THEN upper_bound END AS speed_function_upper_bound, banned AS first_banned FROM <VEHICLES> v")
def read_vehicle_types(spark, sf_dir):
    v = d.frame(spark, sf_dir, d.VEHICLES)
    speed = F.when(F.col("kind") == 0, F.struct(F.lit("UpperBound").alias("type"), F.col("upper_bound").alias("upper_bound")))
    got = _back(spark, v.select("vehicle_id", F.lit(7).alias("headway"), speed.alias("speed_function"), F.array("banned").alias("restricted_edges")), "vehicle_types", "parquet", "vehicle_types")
    return got.select("vehicle_id", "headway", "pce", "speed_function_type", "speed_function_upper_bound", F.get("restricted_edges", F.lit(0)).alias("first_banned"))


@query("SELECT 1::BIGINT AS vehicle_id, edge_id, k, y AS value FROM <GRID> g")
def read_conditions(spark, sf_dir):
    """Network conditions in long form, as one function for each edge."""
    given = d.frame(spark, sf_dir, d.GRID).select(F.lit(1).alias("vehicle_id"), "edge_id", F.col("x").alias("departure_time"), F.col("y").alias("travel_time"))
    rows = _back(spark, given, "conditions", "csv", "road_network_conditions")
    built = pwl.build(rows, ["vehicle_id", "edge_id"], "departure_time", "travel_time", 0.0)
    return built.select("vehicle_id", "edge_id", F.posexplode("ttf.points").alias("k", "value")).select("vehicle_id", "edge_id", F.col("k").cast("bigint").alias("k"), "value")


@query("SELECT edge_id, CASE WHEN edge_id % 2 = 0 THEN count(*) ELSE 0 END::BIGINT AS points, CASE WHEN edge_id % 2 = 0 THEN max(y) ELSE 1e0 END AS greatest FROM <GRID> g GROUP BY edge_id")
def read_routing_edges(spark, sf_dir):
    """Edges of a routing job: one second each, or a function where one is given."""
    ends = _back(spark, d.frame(spark, sf_dir, d.EDGES).select("edge_id", "source", "target"), "edges", "csv", "routing_edges")
    grid = d.frame(spark, sf_dir, d.GRID).where("edge_id % 2 = 0").select("edge_id", F.col("x").alias("departure_time"), F.col("y").alias("travel_time"))
    got = routing_job.graph_edges(ends, _back(spark, grid, "ttfs", "parquet", "edge_ttfs"))
    return got.select("edge_id", pwl.complexity(F.col("ttf")).cast("bigint").alias("points"), pwl.greatest(F.col("ttf")).alias("greatest"))


@query("SELECT trip_id AS query_id, origin, destination, CASE WHEN dt_kind = 0 THEN departure END AS departure_time FROM <TRIPS> t")
def read_queries(spark, sf_dir):
    t = d.frame(spark, sf_dir, d.TRIPS)
    given = t.select(F.col("trip_id").alias("query_id"), "origin", "destination", F.when(F.col("dt_kind") == 0, F.col("departure")).alias("departure_time"))
    return _back(spark, given, "queries", "csv", "queries").select("query_id", "origin", "destination", "departure_time")


@query('SELECT s_suppkey AS node_id, (s_suppkey * 7) % 1000 AS "order" FROM supplier')
def read_node_order(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return _back(spark, s.select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") * 7 % 1000).alias("order")), "order", "csv", "input_order").select("node_id", "order")


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def read_json(spark, sf_dir):
    """Values in a compressed JSON file."""
    rows = [[r.n_nationkey, r.n_name] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()]
    path = f"{_folder(spark)}/values.json.zst"
    sinks.write_json({"nations": rows}, path, compress=True)
    return spark.createDataFrame([tuple(r) for r in sinks.read_json_file(spark, path)["nations"]], "k bigint, name string")


@query("SELECT unnest(['speed_density.colour', 'surplus']) AS name")
def unused_columns(spark, sf_dir):
    """Columns that no logical one names."""
    given = d.frame(spark, sf_dir, d.EDGES).select("edge_id", "source", "target", "speed", "length", F.lit(1).alias("surplus"), F.struct(F.lit("Bottleneck").alias("type"), F.lit("red").alias("colour")).alias("speed_density"))
    return spark.createDataFrame([(n,) for n in tables.unused(given, tables.TABLES["edges"][0])], "name string")


def _problem(name: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{name}: {m}'" for c, m in rules) + " END"


@query(
    f"""SELECT edge_id, problem FROM (SELECT edge_id, {_problem("edges", [("edge_id % 7 = 1", "speed must be positive"), ("edge_id % 7 = 2", "length must not be negative"), ("edge_id % 7 = 3", "lanes must be positive"), ("edge_id % 7 = 4", "unknown speed_density.type"), ("edge_id % 7 = 5", "a bottleneck needs a positive capacity"), ("edge_id % 7 = 6", "source must not be null")])} AS problem FROM <EDGES> e) q WHERE problem IS NOT NULL"""
)
def edge_problems(spark, sf_dir):
    """Edges that break a rule, and which one."""
    e = d.frame(spark, sf_dir, d.EDGES)
    bad = F.col("edge_id") % 7
    given = e.select(
        "edge_id", F.when(bad != 6, F.col("source")).alias("source"), "target", F.when(bad == 1, 0.0).otherwise(F.col("speed")).alias("speed"), F.when(bad == 2, -1.0).otherwise(F.col("length")).alias("length"),
        F.when(bad == 3, 0.0).alias("lanes"), F.struct(F.when(bad == 4, "Tunnel").when(bad == 5, "Bottleneck").alias("type")).alias("speed_density"),
    )
    return tables.problems(given, "edges")


@query(
    f"""SELECT agent_id, 1::BIGINT AS alt_id, problem FROM (SELECT c_custkey AS agent_id, {_problem("alternatives", [("c_custkey % 8 = 1", "origin_delay must not be negative"), ("c_custkey % 8 = 2", "unknown dt_choice.type"), ("c_custkey % 8 = 3", "a constant departure needs a departure_time of 0 or more"), ("c_custkey % 8 = 4", "a Logit model needs u and mu"), ("c_custkey % 8 = 5", "u must be within 0 and 1"), ("c_custkey % 8 = 6", "mu must be positive"), ("c_custkey % 8 = 7", "tstar must be delta / 2 or more")])} AS problem FROM customer) q WHERE problem IS NOT NULL"""
)
def alternative_problems(spark, sf_dir):
    """Alternatives that break a rule of their departure choice or utilities, and which one."""
    bad, key = F.col("c_custkey") % 8, F.col("c_custkey")
    smooth = bad.isin(4, 5, 6)
    model = F.when(smooth, F.struct(F.lit("Logit").alias("type"), F.when(bad != 4, F.when(bad == 5, 1.5).otherwise(0.5)).alias("u"), F.when(bad == 6, 0.0).otherwise(1.0).alias("mu")))
    kind = F.when(bad == 2, "Sometimes").when(smooth, "Continuous").otherwise("Constant")
    choice = F.struct(kind.alias("type"), F.when(bad == 3, -5.0).otherwise(60.0).alias("departure_time"), model.alias("model"))
    side = F.when(bad == 7, F.struct(F.lit("Linear").alias("type"), F.lit(10.0).alias("tstar"), F.lit(30.0).alias("delta")))
    given = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("agent_id"), F.lit(1).alias("alt_id"), F.when(bad == 1, -1.0).alias("origin_delay"), choice.alias("dt_choice"), side.alias("origin_utility"))
    return tables.problems(given, "alternatives")


@query("SELECT trip_id % 1000 AS edge_id, count(*)::BIGINT AS rows FROM <TRIPS> t GROUP BY trip_id % 1000 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Keys that occur more than once."""
    t = d.frame(spark, sf_dir, d.TRIPS).select((F.col("trip_id") % 1000).alias("edge_id"), F.col("origin").alias("source"), F.col("destination").alias("target"))
    return tables.duplicates(tables.read(t, "routing_edges"), "routing_edges")


def _conditions_world(spark, sf_dir):
    """Two vehicles on the derived roads, with given conditions on every third road and on roads that are not there."""
    from wayfare.plans import simulation
    from wayfare.plans.parameters import RoadNetwork, SimulationParameters

    e = d.frame(spark, sf_dir, d.EDGES)
    both = e.select(F.explode(F.lit([0, 1])).alias("vehicle_id"), "edge_id")
    given = both.where("edge_id % 3 = 0").select("vehicle_id", "edge_id", F.lit(0.0).alias("departure_time"), (F.col("vehicle_id") + 100.0).alias("travel_time"))
    stray = both.select("vehicle_id", (F.col("edge_id") + 1_000_000).alias("edge_id"), F.lit(0.0).alias("departure_time"), F.lit(5.0).alias("travel_time"))  # edges that are not there are dropped
    path = _file(given.unionByName(stray), "conditions", "parquet")
    p = SimulationParameters({"road_network_conditions": path}, (0.0, 3600.0), road_network=RoadNetwork(600.0, spillback=False))
    vehicles = spark.createDataFrame([(0, 1.0), (1, 1.0)], "vehicle_id bigint, headway double")
    agents = spark.createDataFrame([(1,)], "agent_id bigint")
    alternatives = spark.createDataFrame([(1, 1)], "agent_id bigint, alt_id bigint")
    roads = e.select("edge_id", "source", "target", "speed", "length")
    return simulation.world(spark, p, {n: tables.read(t, n) for n, t in (("agents", agents), ("alternatives", alternatives), ("edges", roads), ("vehicle_types", vehicles))})


@query("SELECT uvehicle, edge_id, CASE WHEN edge_id % 3 = 0 THEN 100e0 + uvehicle ELSE round(length / speed, 6) END AS travel_time FROM <EDGES> e CROSS JOIN (SELECT unnest([0::BIGINT, 1]) AS uvehicle) v")
def completed_conditions(spark, sf_dir):
    """Given conditions where there are any, those of empty roads elsewhere."""
    from wayfare.plans import simulation

    w = _conditions_world(spark, sf_dir)
    got = simulation.initial_weights(spark, w, simulation.free_flow(w))
    return got.select("uvehicle", "edge_id", r6("ttf.cst").alias("travel_time"))


@query("""SELECT uvehicle, count(*) AS n_edges, CAST(min(edge_id) AS BIGINT) AS first_edge, CAST(max(edge_id) FILTER (WHERE k <= 5) AS BIGINT) AS last_named, count(*) FILTER (WHERE k <= 5) AS n_named
  FROM (SELECT uvehicle, edge_id, row_number() OVER (PARTITION BY uvehicle ORDER BY edge_id) AS k FROM <EDGES> e CROSS JOIN (SELECT unnest([0::BIGINT, 1]) AS uvehicle) v WHERE edge_id % 3 <> 0) missing GROUP BY uvehicle""")
def missing_functions(spark, sf_dir):
    """Edges without given conditions by vehicle: how many, and those that the warning names."""
    from wayfare.plans import simulation

    w = _conditions_world(spark, sf_dir)
    given = tables.read(tables.scan(spark, w.p.input_files["road_network_conditions"]), "road_network_conditions").select(F.col("vehicle_id").alias("uvehicle"), "edge_id", F.lit(1).alias("given"))
    both = simulation.free_flow(w).select("uvehicle", "edge_id").join(given, ["uvehicle", "edge_id"], "left")
    found = simulation.missing_functions(both)
    return found.select("uvehicle", "n_edges", F.col("edges")[0].alias("first_edge"), F.element_at("edges", -1).alias("last_named"), F.size("edges").cast("bigint").alias("n_named"))



_ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, round(o_totalprice, 2) AS price FROM orders"


def _roundtrip(fmt: str):
    def run(spark, sf_dir):
        folder = _folder(spark)
        o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.round("o_totalprice", 2).alias("price"))
        path = sinks.write_table(o.where("k % 2 = 0"), folder, "rows", fmt)
        sinks.append_rows(o.where("k % 2 = 1"), folder, "rows", fmt)
        reader = spark.read.schema("k bigint, c bigint, price double")
        return reader.option("header", True).csv(path) if fmt == "CSV" else reader.format(fmt.lower()).load(path)

    return run


for _fmt in ("Parquet", "CSV", "JSON"):
    _f = _roundtrip(_fmt)
    _f.__name__ = f"sink_{_fmt.lower()}"
    query(_ORDERS)(_f)


@query("SELECT 0::BIGINT AS empty_files, 2::BIGINT AS listed, 'b' AS last")
def sink_json_lists(spark, sf_dir):
    """An empty table gives no file; a JSON list grows by what is appended."""
    folder = _folder(spark)
    sinks.write_table(spark.read.parquet(f"{sf_dir}/nation.parquet").where("false"), folder, "nothing")
    for value in ("a", "b"):
        sinks.append_json(value, f"{folder}/list.json")
    listed = sinks.read_json_file(spark, f"{folder}/list.json")
    return spark.createDataFrame([(int(files.exists(f"{folder}/nothing.parquet", spark)), len(listed), listed[-1])], "empty_files bigint, listed bigint, last string")


_SKIMS = """SELECT uvehicle::VARCHAR AS vehicle, origin, destination, origin + 60e0 AS first, destination / 4e0 AS last, CASE WHEN destination % 3 = 0 THEN 60e0 * destination END AS cst
  FROM (SELECT DISTINCT uvehicle, origin, destination FROM <TRIPS> t) pairs"""


def _skims(most: int):
    def run(spark, sf_dir):
        pairs = d.frame(spark, sf_dir, d.TRIPS).select("uvehicle", "origin", "destination").distinct()
        ttf = F.expr("named_struct('start_x', 0D, 'interval_x', 3600D, 'points', array(origin + 60D, 1.5D, destination / 4D), 'cst', if(destination % 3 = 0, 60D * destination, null))")
        path = sinks.write_json_rows(pairs.withColumn("ttf", ttf), "uvehicle", f"{_folder(spark)}/skims.json.zst", most)
        rows = sinks.read_json_rows(spark, path, "vehicle", f"origin bigint, destination bigint, ttf {pwl.TYPE}")
        return rows.select("vehicle", "origin", "destination", F.col("ttf.points")[0].alias("first"), F.element_at("ttf.points", -1).alias("last"), "ttf.cst")

    return run


for _name, _most, _text in (("sink_skims", sinks.MOST_ROWS_OF_ONE_FILE, "one compressed JSON file, or parts if they are many"), ("sink_skims_parts", 0, "the parts of a compressed JSON document")):
    _f = _skims(_most)
    _f.__name__, _f.__doc__ = _name, f"Functions of pairs by vehicle in {_text}, read back by Spark."
    query(_SKIMS)(_f)


@query("SELECT trip_id, destination FROM <TRIPS> t WHERE destination >= <NODES> - 3")
def unknown_destinations(spark, sf_dir):
    """Trips to nodes that a smaller network does not have."""
    t = d.frame(spark, sf_dir, d.TRIPS)
    nodes = network.nodes(d.frame(spark, sf_dir, d.EDGES))
    n = nodes.count()
    kept = nodes.where(F.col("node_id") < n - 3)
    return t.join(kept, t["destination"] == kept["node_id"], "left_anti").select("trip_id", "destination")
