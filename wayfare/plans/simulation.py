"""Full simulation: decisions, within-day events, learning, summaries, day after day.

Tables carry everything; Python runs only in group functions (searches on a graph that was checked to fit a worker,
and the event model), and on the driver for the loop and one row of figures per iteration.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions import pwl, scalars
from wayfare.operators import choice, hubs, learning, network, routing, summary
from wayfare.plans import report
from wayfare.plans.parameters import SimulationParameters, simulation_parameters
from wayfare.plans.within_day import MOST_LEGS, components, queue_steps
from wayfare.sources import sinks, tables
from wayfare.sources.shared import cut_sized as cut
from wayfare.streaming import gates
from wayfare.streaming.supply import Edge, Leg, Simulation, Trip, Vehicle, density_rule

SCHEDULE = ("kind", "tstar", "beta", "gamma", "delta")


@dataclass
class World:
    """Input tables of a simulation after checks."""

    p: SimulationParameters
    agents: DataFrame
    alternatives: DataFrame
    legs: DataFrame | None
    edges: DataFrame | None
    vehicles: DataFrame | None
    skims: DataFrame | None = None


def load(spark: SparkSession, p: SimulationParameters) -> World:
    """Read and check all inputs.  Trips and alternatives without a parent are dropped; an agent without alternatives is an error."""
    files = p.input_files

    def get(name: str) -> DataFrame | None:
        if name not in files:
            return None
        table = tables.read(tables.scan(spark, files[name]), name)
        tables.require_rows(table, name)
        tables.require_unique(table, name)
        return cut(table, name)

    return world(spark, p, {n: get(n) for n in ("agents", "alternatives", "trips", "edges", "vehicle_types")})


def world(spark: SparkSession, p: SimulationParameters, given: dict[str, DataFrame | None]) -> World:
    """The checked world of logical tables (agents, alternatives, and maybe trips, edges, vehicle_types)."""
    files = p.input_files
    agents, alternatives, trips, edges, vehicles = (given.get(n) for n in ("agents", "alternatives", "trips", "edges", "vehicle_types"))
    if (edges is None) != (vehicles is None):
        raise ValueError("edges and vehicle_types are needed together")
    if edges is not None and p.road_network is None:
        raise ValueError("a road network needs road_network parameters")
    if edges is not None:  # a column without any value has no type of its own
        edge, node = dict(edges.dtypes)["edge_id"], dict(edges.dtypes)["source"]
        vehicles = vehicles.withColumns({c: F.col(c).cast(f"array<{edge}>") for c in ("allowed_edges", "restricted_edges")})
        if trips is not None:
            trips = trips.withColumns({"class_route": F.col("class_route").cast(f"array<{edge}>"), "class_origin": F.col("class_origin").cast(node), "class_destination": F.col("class_destination").cast(node)})
    lonely = agents.join(alternatives, "agent_id", "left_anti").limit(10).collect()
    if lonely:
        raise ValueError(f"agents without alternatives: {[r.agent_id for r in lonely]}")
    ordered = Window.partitionBy("agent_id").orderBy("row_index")
    alternatives = cut(alternatives.join(agents.select("agent_id"), "agent_id", "left_semi").withColumn("alt_index", F.row_number().over(ordered) - 1), "alternatives")
    legs = None
    if trips is not None:
        order = Window.partitionBy("agent_id", "alt_id").orderBy("row_index")
        legs = cut(trips.join(alternatives.select("agent_id", "alt_id"), ["agent_id", "alt_id"], "left_semi").withColumn("trip_index", F.row_number().over(order) - 1), "legs")
        road = legs.where("class_type = 'Road'")
        if edges is None:
            if not road.isEmpty():
                raise ValueError("road trips need edges and vehicle_types")
        else:
            nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
            tables.require_known(road.select("class_origin"), nodes, "origins that are no nodes")
            tables.require_known(road.select("class_destination"), nodes, "destinations that are no nodes")
            tables.require_known(road.select("class_vehicle"), vehicles.select("vehicle_id"), "vehicles that are no vehicle types")
            ids = edges.select("edge_id")
            for column in ("allowed_edges", "restricted_edges"):
                tables.require_known(vehicles.select(F.explode(column).alias("e")), ids, f"{column} that are no edges")
            parallel = edges.groupBy("source", "target").count().where("count > 1").limit(1).collect()
            if parallel:
                raise ValueError(f"parallel edges from {parallel[0].source} to {parallel[0].target}")
    if vehicles is not None:
        sets = [F.to_json(F.array_sort(F.array_distinct(F.coalesce(c, F.array())))) for c in ("allowed_edges", "restricted_edges")]
        same = F.to_json(F.struct("speed_function_type", "speed_function_upper_bound", "speed_function_coef", "speed_function_x", "speed_function_y", *sets))
        given = F.lit("")
        if "road_network_conditions" in files:
            # equal vehicles with different conditions are told apart
            rows = tables.read(tables.scan(spark, files["road_network_conditions"]), "road_network_conditions")
            signs = rows.groupBy("vehicle_id").agg(F.md5(F.to_json(F.sort_array(F.collect_list(F.struct("edge_id", "departure_time", "travel_time"))))).alias("conditions"))
            vehicles = vehicles.join(signs, "vehicle_id", "left")
            given = F.coalesce("conditions", F.lit(""))
        vehicles = cut(vehicles.withColumn("uvehicle", F.first("vehicle_id").over(Window.partitionBy(same, given).orderBy("row_index"))).drop("conditions"), "vehicles")
    return World(p, agents, alternatives, legs, edges, vehicles)


# --- weights -------------------------------------------------------------------------------


def _open_edges(w: World) -> DataFrame:
    """Columns of vehicle and edge for every unique vehicle and edge that it may use."""
    unique = w.vehicles.where("vehicle_id = uvehicle").drop("row_index")
    return network.accessible_edges(unique, w.edges.drop("row_index"))


def _base_speed() -> F.Column:
    return scalars.vehicle_speed(*[F.col(c) for c in ("speed", "speed_function_type", "speed_function_upper_bound", "speed_function_coef", "speed_function_x", "speed_function_y")])


def _time_at(occupied, base=None) -> F.Column:
    names = ("speed_density_type", "speed_density_capacity", "speed_density_min_density", "speed_density_jam_density", "speed_density_jam_speed", "speed_density_beta")
    speed = scalars.congested_speed(_base_speed() if base is None else base, occupied, F.col("length") * F.col("lanes"), *[F.col(c) for c in names])
    return scalars.edge_travel_time(F.col("length"), speed, F.col("constant_travel_time"))


def free_flow(w: World) -> DataFrame:
    """uvehicle, edge_id, free_flow (seconds)."""
    return _open_edges(w).select("uvehicle", "edge_id", _time_at(F.lit(0.0)).alias("free_flow"))


def initial_weights(spark: SparkSession, w: World, free: DataFrame) -> DataFrame:
    """uvehicle, edge_id, ttf: conditions from a file where given, free flow elsewhere.

    Conditions of unknown vehicles and of edges that a vehicle may not use are dropped.  Equal vehicles share the conditions of the first one with any.
    """
    constant = free.select("uvehicle", "edge_id", pwl.constant(F.col("free_flow")).cast(pwl.TYPE).alias("ttf"))
    if "road_network_conditions" not in w.p.input_files:
        return cut(constant, "weights")
    rows = tables.read(tables.scan(spark, w.p.input_files["road_network_conditions"]), "road_network_conditions")
    rows = rows.join(w.vehicles.select("vehicle_id", "uvehicle"), "vehicle_id")
    kept = rows.where(F.col("vehicle_id").eqNullSafe(F.col("uvehicle")))
    built = pwl.build(kept, ["uvehicle", "edge_id"], "departure_time", "travel_time", w.p.period[0]).withColumnRenamed("ttf", "given")
    both = cut(constant.join(built, ["uvehicle", "edge_id"], "left"), "conditions")
    for row in missing_functions(both).limit(_MOST_WARNINGS).collect():
        tables.log.warning("vehicle %s: no function is given for %s edges (such as %s), they are taken as empty", row.uvehicle, row.n_edges, ", ".join(map(str, row.edges)))
    return cut(both.select("uvehicle", "edge_id", F.coalesce("given", "ttf").alias("ttf")), "weights")


#: Vehicles that are warned of at most, and edges that are named for each.
_MOST_WARNINGS = 100
_NAMED_EDGES = 5


def missing_functions(conditions: DataFrame) -> DataFrame:
    """uvehicle, n_edges, edges: how many edges of a vehicle have no ``given`` function, and the first few of them.

    The first few are ranked with a limit in every task before the shuffle, so that a vehicle with most of the edges is none's burden.
    """
    none = conditions.where(F.col("given").isNull()).select("uvehicle", "edge_id")
    few = none.withColumn("rank", F.row_number().over(Window.partitionBy("uvehicle").orderBy("edge_id"))).where(F.col("rank") <= _NAMED_EDGES)
    named = few.groupBy("uvehicle").agg(F.sort_array(F.collect_list("edge_id")).alias("edges"))
    return none.groupBy("uvehicle").agg(F.count("*").alias("n_edges")).join(named, "uvehicle").orderBy("uvehicle")


def _graphs(w: World, weights: DataFrame) -> dict:
    """A graph for each unique vehicle; together they must fit in a worker.  None where every road leg has its route: nothing is searched for."""
    if w.legs is None or w.legs.where("class_type = 'Road' and class_route is null").isEmpty():
        return {}
    ends = w.edges.select("edge_id", "source", "target")
    if routing.too_large(weights):
        raise ValueError("the graphs of all vehicles are too large for one worker together")
    return {r.uvehicle: routing.load_graph(weights.where(F.col("uvehicle") == r.uvehicle).join(ends, "edge_id")) for r in w.vehicles.select("uvehicle").distinct().collect()}


# --- decisions -----------------------------------------------------------------------------

LEG = "struct<trip_index: int, trip_id: {trip}, road: boolean, vehicle: {vehicle}, uvehicle: {vehicle}, origin: {node}, destination: {node}, route: array<{edge}>, spent: double, stopping: double>"


def _prefixed(prefix: str) -> dict:
    return {k: F.col(f"{prefix}_{'type' if k == 'kind' else k}") for k in SCHEDULE}


def _leg_struct(ttf: F.Column) -> F.Column:
    utility = {k: F.coalesce(f"travel_utility_{k}", F.lit(0.0)).alias(k) for k in ("one", "two", "three", "four")}
    schedule = [c.alias(k) for k, c in _prefixed("schedule_utility").items()]
    return F.struct("trip_index", ttf.alias("ttf"), F.col("stopping_time").alias("stopping"), F.col("constant_utility").alias("constant"), *utility.values(), F.col("alpha").alias("alpha"), *schedule)


def skims_of(w: World, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """origin, destination, ttf of one vehicle's pairs by the strategy of the parameters; all of them are exact at the points of the grid.

    "Best" and "Dijkstra" search once for each origin, on the workers or, for a graph beyond one of them, by rounds of joins; "Intersect" and "TCH"
    meet at the hubs of labels, whose making pays where they are used again; where those outgrow ``hubs.MOST_POINTS`` they search too.
    """
    kind = w.p.road_network.algorithm_type if w.p.road_network else "Best"
    if kind in ("Best", "Dijkstra"):
        return routing.profiles(pairs, edges)
    if kind not in ("Intersect", "TCH"):
        raise ValueError(f"unknown algorithm_type {kind}")
    labels = hubs.hub_labels(edges, most=hubs.MOST_POINTS)
    if labels is None:
        return routing.profiles(pairs, edges)
    different = pairs.select("origin", "destination").distinct()
    return different.join(hubs.hub_profiles(different, labels, hubs.grid_of(edges)), ["origin", "destination"], "left")


def leg_functions(w: World, weights: DataFrame | None) -> DataFrame:
    """Legs with ``uvehicle`` and ``ttf``: null for road legs of constant departures without a route, which are searched for."""
    legs = w.legs.join(w.alternatives.select("agent_id", "alt_id", "dt_choice_type"), ["agent_id", "alt_id"])
    virtual = pwl.constant(F.coalesce("class_travel_time", F.lit(0.0))).cast(pwl.TYPE)
    if weights is None:
        return legs.withColumn("uvehicle", F.lit(None).cast("string")).withColumn("ttf", virtual)
    legs = legs.join(w.vehicles.select(F.col("vehicle_id").alias("class_vehicle"), "uvehicle"), "class_vehicle", "left")
    # given routes: a fold of links over the edges' functions
    steps = legs.where("class_route is not null").select("agent_id", "alt_id", "trip_index", "uvehicle", F.posexplode("class_route").alias("k", "edge_id")).join(weights, ["uvehicle", "edge_id"], "left")
    ways = steps.groupBy("agent_id", "alt_id", "trip_index").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("ttf", F.raise_error(F.lit("a route uses an edge that its vehicle may not")).cast(pwl.TYPE)).alias("ttf")))).alias("fs"))
    folded = F.aggregate("fs", pwl.constant(F.lit(0.0)).cast(pwl.TYPE), lambda f, g: pwl.link(f, g["ttf"]).cast(pwl.TYPE))
    legs = legs.join(ways.select("agent_id", "alt_id", "trip_index", folded.alias("route_ttf")), ["agent_id", "alt_id", "trip_index"], "left")
    wanted = legs.where("class_type = 'Road' and class_route is null and dt_choice_type in ('Discrete', 'Continuous')").select("uvehicle", F.col("class_origin").alias("origin"), F.col("class_destination").alias("destination")).distinct()
    skims = None
    for r in wanted.select("uvehicle").distinct().collect():
        own = wanted.where(F.col("uvehicle") == r.uvehicle)
        found = skims_of(w, own, weights.where(F.col("uvehicle") == r.uvehicle).join(w.edges.select("edge_id", "source", "target"), "edge_id")).withColumn("uvehicle", F.lit(r.uvehicle))
        skims = found if skims is None else skims.unionByName(found)
    if skims is None:
        legs = legs.withColumn("skim_ttf", F.lit(None).cast(pwl.TYPE))
    else:
        w.skims = cut(skims, "skims")
        skims = w.skims.select("uvehicle", F.col("origin").alias("class_origin"), F.col("destination").alias("class_destination"), F.col("ttf").alias("skim_ttf"))
        legs = legs.join(skims, ["uvehicle", "class_origin", "class_destination"], "left")
        no_way = F.col("skim_ttf").isNull() & (F.col("class_type") == "Road") & F.col("class_route").isNull() & F.col("dt_choice_type").isin("Discrete", "Continuous")
        legs = legs.withColumn("skim_ttf", F.when(no_way, F.raise_error(F.format_string("no route from %s to %s", F.col("class_origin").cast("string"), F.col("class_destination").cast("string"))).cast(pwl.TYPE)).otherwise(F.col("skim_ttf")))
    own = F.when(F.col("class_type") == "Virtual", virtual).otherwise(F.coalesce("route_ttf", "skim_ttf"))
    return legs.withColumn("ttf", own)


def walk(w: World, trips: DataFrame, weights: DataFrame | None, graphs: dict) -> DataFrame:
    """Expected course of trips (agent_id, alt_id, departure, origin_delay, legs array): one row for each leg.

    Legs follow each other; a road leg takes its given route or the fastest one at its departure.  Without graphs all routes are given, and
    the course is a fold over the functions of their edges.
    """
    if not graphs:
        return _walk_given(trips, weights)
    spark = trips.sparkSession
    sent = spark.sparkContext.broadcast(graphs)  # checked by load_graph
    kinds = dict(trips.dtypes)
    node, edge = kinds["origin_type"], kinds["edge_type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for agent, alt, departure, delay, legs in zip(batch["agent_id"], batch["alt_id"], batch["departure"], batch["origin_delay"], batch["legs"], strict=True):
                t = departure + delay
                for leg in legs:
                    route = None
                    if not leg["road"]:
                        end = t + leg["spent"]
                    else:
                        graph = sent.value[leg["uvehicle"]]
                        if leg["route"] is not None:
                            route, end = list(leg["route"]), t
                            for e in route:
                                end += graph.evaluate(graph.functions[e], end)
                        else:
                            found = graph.earliest_route(leg["origin"], leg["destination"], t)
                            if found is None:
                                raise ValueError(f"no route from {leg['origin']} to {leg['destination']} at {t}")
                            end, route = found
                    out.append((agent, alt, int(leg["trip_index"]), t, end, route))
                    t = end + leg["stopping"]
            yield pd.DataFrame(out, columns=["agent_id", "alt_id", "trip_index", "leg_departure", "leg_arrival", "leg_route"])

    del node
    schema = f"agent_id {kinds['agent_id']}, alt_id {kinds['alt_id']}, trip_index int, leg_departure double, leg_arrival double, leg_route array<{edge}>"
    return trips.select("agent_id", "alt_id", "departure", "origin_delay", "legs").mapInPandas(run, schema)


def _walk_given(trips: DataFrame, weights: DataFrame | None) -> DataFrame:
    """``walk`` where every road leg has its route."""
    edge, keys = dict(trips.dtypes)["edge_type"], ["agent_id", "alt_id"]
    steps = trips.select(*keys, F.explode("legs").alias("leg")).where("leg.road").select(*keys, "leg.trip_index", "leg.uvehicle", F.posexplode("leg.route").alias("k", "edge_id"))
    if weights is None:
        ways = trips.select(*keys, F.lit(None).cast(f"array<struct<trip_index: int, k: int, ttf: {pwl.TYPE}>>").alias("steps")).limit(0)
    else:
        missing = F.raise_error(F.lit("a route uses an edge that its vehicle may not")).cast(pwl.TYPE)
        known = steps.join(weights.select("uvehicle", "edge_id", "ttf"), ["uvehicle", "edge_id"], "left")
        ways = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("trip_index", "k", F.coalesce("ttf", missing).alias("ttf")))).alias("steps"))
    course = "array<struct<trip_index: int, leg_departure: double, leg_arrival: double, leg_route: array<{}>>>".format(edge)

    def pass_leg(done: F.Column, leg: F.Column) -> F.Column:
        own = F.filter(F.coalesce("steps", F.array()), lambda s: s["trip_index"] == leg["trip_index"])
        drive = F.aggregate(own, done["at"], lambda t, s: t + pwl.evaluate(s["ttf"], t))
        end = F.when(leg["road"], drive).otherwise(done["at"] + leg["spent"])
        passed = lambda at: F.struct(leg["trip_index"].cast("int").alias("trip_index"), done["at"].alias("leg_departure"), at.alias("leg_arrival"), F.when(leg["road"], leg["route"]).alias("leg_route"))
        state = lambda at: F.struct((at + leg["stopping"]).alias("at"), F.concat(done["course"], F.array(passed(at))).alias("course"))
        return pwl.bind(end, state).cast(f"struct<at: double, course: {course}>")

    began = F.struct((F.col("departure") + F.col("origin_delay")).alias("at"), F.array().cast(course).alias("course")).cast(f"struct<at: double, course: {course}>")
    walked = trips.join(ways, keys, "left").select(*keys, F.explode(F.aggregate("legs", began, pass_leg)["course"]).alias("x"))
    return walked.select(*keys, "x.*")


def _trips_to_walk(w: World, legs: DataFrame, departures: DataFrame) -> DataFrame:
    """departures (agent_id, alt_id, departure) with what ``walk`` needs of their legs."""
    listed = F.struct(
        "trip_index", "trip_id", (F.col("class_type") == "Road").alias("road"), F.col("uvehicle").alias("uvehicle"), F.col("class_origin").alias("origin"), F.col("class_destination").alias("destination"),
        F.col("class_route").alias("route"), F.coalesce("class_travel_time", F.lit(0.0)).alias("spent"), F.col("stopping_time").alias("stopping"),
    )
    grouped = legs.groupBy("agent_id", "alt_id").agg(F.sort_array(F.collect_list(listed)).alias("legs"))
    edge = dict(w.edges.dtypes)["edge_id"] if w.edges is not None else "bigint"
    joined = departures.join(grouped, ["agent_id", "alt_id"]).join(w.alternatives.select("agent_id", "alt_id", "origin_delay"), ["agent_id", "alt_id"])
    return joined.withColumn("origin_type", F.lit(None).cast(dict(legs.dtypes)["class_origin"])).withColumn("edge_type", F.lit(None).cast(edge))


def _utility_of(departure: F.Column, legs: F.Column) -> F.Column:
    total = {k: F.col(f"total_travel_utility_{k}") for k in ("one", "two", "three", "four")} | {"constant": F.col("constant_utility"), "alpha": F.col("alpha")}
    return scalars.trip_utility(departure, F.col("origin_delay"), legs, total, _prefixed("origin_utility"), _prefixed("destination_utility"))


def decide(w: World, weights: DataFrame | None, graphs: dict) -> DataFrame:
    """agent_id, alt_id, alt_index, departure (null without trips), alt_expected_utility, expected_utility of each agent's choice."""
    p, start, end = w.p, float(w.p.period[0]), float(w.p.period[1])
    alts = w.alternatives
    if w.legs is None:
        values = alts.select("agent_id", "alt_id", "alt_index", F.lit(None).cast("double").alias("departure"), F.col("constant_utility").alias("value"))
    else:
        legs = cut(leg_functions(w, weights), "legs")
        searched = legs.where("ttf is null")
        if not searched.isEmpty():
            starts = alts.where("dt_choice_type = 'Constant'").select("agent_id", "alt_id", F.col("dt_choice_departure_time").alias("departure"))
            starts = starts.join(searched.select("agent_id", "alt_id").distinct(), ["agent_id", "alt_id"], "left_semi")
            found = walk(w, _trips_to_walk(w, legs, starts), weights, graphs)
            course = found.select("agent_id", "alt_id", "trip_index", pwl.constant(F.col("leg_arrival") - F.col("leg_departure")).cast(pwl.TYPE).alias("walked"))
            legs = cut(legs.join(course, ["agent_id", "alt_id", "trip_index"], "left").withColumn("ttf", F.coalesce("ttf", "walked")).drop("walked"), "legs")
        grouped = legs.groupBy("agent_id", "alt_id").agg(F.sort_array(F.collect_list(_leg_struct(F.col("ttf")))).alias("legs"))
        table = cut(alts.join(grouped, ["agent_id", "alt_id"], "left"), "alternatives")
        none = table.where("legs is null").select("agent_id", "alt_id", "alt_index", F.lit(None).cast("double").alias("departure"), F.col("constant_utility").alias("value"))
        fixed = table.where("legs is not null and dt_choice_type = 'Constant'")
        fixed = fixed.select("agent_id", "alt_id", "alt_index", F.col("dt_choice_departure_time").alias("departure"), _utility_of(F.col("dt_choice_departure_time"), F.col("legs")).alias("value"))
        untyped = table.where("legs is not null and dt_choice_type is null").limit(1).collect()
        if untyped:
            raise ValueError(f"alternatives: dt_choice.type is needed where there are trips ({untyped[0].agent_id}, {untyped[0].alt_id})")
        # discrete departures: a row for each midpoint
        lo, hi = F.coalesce(F.col("dt_choice_period")[0], F.lit(start)), F.coalesce(F.col("dt_choice_period")[1], F.lit(end))
        step = F.col("dt_choice_interval")
        n = F.greatest(F.ceil((hi - lo - step / 2) / step).cast("int"), F.lit(1))
        grid = F.transform(F.sequence(F.lit(0), n - 1), lambda k: lo + step / 2 + k * step)
        discrete = table.where("legs is not null and dt_choice_type = 'Discrete'").withColumn("key", F.struct("agent_id", "alt_id"))
        slots = discrete.select("*", F.posexplode(grid).alias("slot", "midpoint")).withColumn("slot_value", _utility_of(F.col("midpoint"), F.col("legs")))
        slots = cut(slots.select("key", "slot", "midpoint", "slot_value", "alt_index", F.col("dt_choice_offset").alias("offset"), lo.alias("lo"), hi.alias("hi"), *[F.col(f"dt_choice_model_{k}").alias(f"m_{k}") for k in ("type", "u", "mu", "constants")]), "slots")
        chosen = choice.choose(slots, "key", "slot", "slot_value", "m_type", "m_u", "m_mu", "m_constants")
        timed = slots.join(chosen.withColumnRenamed("chosen", "slot"), ["key", "slot"])
        timed = timed.select("key.agent_id", "key.alt_id", "alt_index", F.least(F.greatest(F.col("midpoint") + F.coalesce("offset", F.lit(0.0)), "lo"), "hi").alias("departure"), F.col("payoff").alias("value"))
        # continuous departures: utility as a function of time
        dt = float(p.departure_time_interval)
        steps = F.floor((hi - lo) / dt + 1e-9).cast("int")
        continuous = table.where("legs is not null and dt_choice_type = 'Continuous'")
        # an agent's whole function is made in its row; rows so small would come in one partition
        dealt = continuous.repartition(max(1, int(continuous.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "agent_id", "alt_id")
        ys = F.transform(F.sequence(F.lit(0), steps), lambda k: pwl.bind(lo + k * dt, lambda x: _utility_of(x, F.col("legs"))))
        functions = dealt.select("agent_id", "alt_id", "alt_index", lo.alias("lo"), ys.alias("ys"), F.col("dt_choice_model_u").alias("u"), F.col("dt_choice_model_mu").alias("mu"))
        drawn = functions.withColumn("c", choice.continuous_logit(pwl.piecewise(F.col("lo"), F.lit(dt), F.col("ys")), F.col("u"), F.col("mu")))
        smooth = drawn.select("agent_id", "alt_id", "alt_index", F.col("c.x").alias("departure"), F.col("c.payoff").alias("value"))
        values = none.unionByName(fixed).unionByName(timed).unionByName(smooth)
    values = cut(values, "values")
    rows = values.join(w.agents.drop("row_index"), "agent_id")
    picked = choice.choose(rows, "agent_id", "alt_index", "value", "alt_choice_type", "alt_choice_u", "alt_choice_mu", "alt_choice_constants")
    won = values.join(picked.withColumnRenamed("chosen", "alt_index"), ["agent_id", "alt_index"])
    return cut(won.select("agent_id", "alt_id", "alt_index", "departure", F.col("value").alias("alt_expected_utility"), F.col("payoff").alias("expected_utility")), "choices")


# --- within-day ----------------------------------------------------------------------------


def expected_legs(w: World, choices: DataFrame, weights: DataFrame | None, graphs: dict) -> DataFrame:
    """Legs of the chosen trips with leg_departure, leg_arrival, leg_route as expected."""
    legs = w.legs.join(choices.where("departure is not null").select("agent_id", "alt_id", F.col("departure")), ["agent_id", "alt_id"])
    if w.vehicles is None:
        legs = legs.withColumn("uvehicle", F.lit(None).cast("string"))
    else:
        legs = legs.join(w.vehicles.select(F.col("vehicle_id").alias("class_vehicle"), "uvehicle"), "class_vehicle", "left")
    starts = choices.where("departure is not null").select("agent_id", "alt_id", "departure").join(legs.select("agent_id", "alt_id").distinct(), ["agent_id", "alt_id"], "left_semi")
    found = walk(w, _trips_to_walk(w, legs, starts), weights, graphs)
    return cut(legs.join(found, ["agent_id", "alt_id", "trip_index"]), "expected")


_OUT = "kind string, agent_id {agent}, trip_index int, leg_departure double, leg_arrival double, road_time double, in_time double, out_time double, exp_arrival double, trip_arrival double, edges array<{edge}>, entries array<double>, edge_id {edge}, t double, y double"


def _only_queues(w: World, legs: DataFrame) -> bool:
    """Whether edges act on nothing but the vehicles at their gates and on them, and all routes are known: no spillback.

    Roads without overtaking at their exits take a round for each vehicle that a merge puts in another order, so that they go this way only
    where the event model might not hold their legs, and need gates of constant flow."""
    if w.edges is None or w.p.road_network.spillback:
        return False
    if not w.edges.where("not overtaking").isEmpty():
        steps = legs.where("class_type = 'Road'").agg(F.sum(F.size("leg_route"))).first()[0] or 0
        if steps <= MOST_LEGS or not w.edges.where("not overtaking and bottleneck_flow is null and size(bottleneck_flows) > 0").isEmpty():
            return False
    return legs.where("class_type = 'Road' and leg_route is null").isEmpty()


def within_day_queues(w: World, legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as ``within_day`` by rounds of window functions over all legs."""
    delays = w.alternatives.select("agent_id", "alt_id", "origin_delay")
    legs = legs.join(delays, ["agent_id", "alt_id"])
    spent = F.when(F.col("class_type") == "Virtual", F.coalesce("class_travel_time", F.lit(0.0))).otherwise(0.0)
    # what passes between the edges of a trip: stops and virtual legs, and the origin's delay before the first leg
    order = Window.partitionBy("agent_id").orderBy("trip_index")
    pause = F.coalesce(F.lag("stopping_time").over(order), F.col("origin_delay"))
    idle = F.sum(pause + F.coalesce(F.lag("virtual_time").over(order), F.lit(0.0))).over(order)
    legs = cut(legs.withColumn("virtual_time", spent).withColumn("idle", idle), "timed_legs")
    dense = not w.edges.where("speed_density_type <> 'FreeFlow'").isEmpty()
    varying = not w.edges.where("bottleneck_flows is not null").isEmpty()
    density = ["base", "length", "lanes", "constant_travel_time", *[f"speed_density_{c}" for c in ("type", "capacity", "min_density", "jam_density", "jam_speed", "beta")]]
    open_edges = _open_edges(w).withColumn("base", _base_speed()).select("uvehicle", "edge_id", _time_at(F.lit(0.0)).alias("spent"), "bottleneck_flow", "bottleneck_times", "bottleneck_flows", "overtaking", *density)
    types = w.vehicles.select(F.col("vehicle_id").alias("class_vehicle"), F.col("pce").alias("own_pce"), F.col("headway").alias("own_headway"))
    steps = legs.where("class_type = 'Road'").select("agent_id", "trip_index", "departure", "idle", "uvehicle", "class_vehicle", F.posexplode("leg_route").alias("k", "edge_id"))
    closing = scalars.closing_time(F.col("own_pce"), F.col("bottleneck_flow"), F.col("lanes"))
    steps = steps.join(open_edges, ["uvehicle", "edge_id"]).join(types, "class_vehicle")
    place = F.struct("trip_index", "k")
    gap = F.col("idle") - F.coalesce(F.lag("idle").over(Window.partitionBy("agent_id").orderBy("trip_index", "k")), F.lit(0.0))
    more, spent_at = [F.col("trip_index").alias("leg")], None
    if not w.edges.where("not overtaking").isEmpty():
        more.append((~F.col("overtaking")).alias("ordered"))
    if varying:
        given = F.col("bottleneck_flow").isNull() & (F.size("bottleneck_flows") > 0)
        more += [F.when(given, F.col("bottleneck_times")).otherwise(F.array(F.lit(0.0))).alias("flow_times"), F.when(given, F.transform("bottleneck_flows", lambda f: scalars.closing_time(F.col("own_pce"), f, F.col("lanes")))).otherwise(F.array(closing)).alias("closings")]
    if dense:
        speed = w.p.road_network.backward_wave_speed
        more += [*density, F.col("own_headway").alias("headway"), (F.col("length") / speed if speed else F.lit(0.0)).alias("wave")]
        spent_at = lambda occupied: _time_at(occupied, F.col("base"))
    rows = steps.select(F.col("agent_id").alias("trip_id"), place.alias("position"), "edge_id", "departure", gap.alias("gap"), "spent", closing.alias("closing"), *more)
    done = cut(queue_steps(rows, w.p.road_network.constrain_inflow, spent_at=spent_at), "queues").withColumn("trip_index", F.col("position.trip_index")).withColumnRenamed("trip_id", "agent_id")
    per_leg = done.groupBy("agent_id", "trip_index").agg(
        F.sum(F.col("at_exit") - F.col("entry_time")).alias("road_time"), F.sum(F.col("entry_time") - F.col("reach_time")).alias("in_time"), F.sum(F.col("exit_time") - F.col("at_exit")).alias("out_time"),
        F.sort_array(F.collect_list(F.struct("position", "edge_id", "entry_time"))).alias("way"),
    )
    joined = legs.join(per_leg, ["agent_id", "trip_index"], "left")
    own = F.coalesce(F.col("road_time") + F.col("in_time") + F.col("out_time"), F.lit(0.0)) + F.col("virtual_time")
    moved = F.coalesce(F.sum(F.coalesce(F.col("road_time") + F.col("in_time") + F.col("out_time"), F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    leaves = F.col("departure") + F.col("idle") + moved
    timed = joined.withColumn("leg_departure", leaves).withColumn("leg_arrival", F.col("leg_departure") + own)
    ends = F.max(F.col("leg_arrival") + F.col("stopping_time")).over(Window.partitionBy("agent_id"))
    is_road = F.col("class_type") == "Road"
    zero, none = F.lit(0.0), F.lit(None)
    edge = dict(w.edges.dtypes)["edge_id"]
    out = timed.select(
        F.lit("leg").alias("kind"), "agent_id", "trip_index", "leg_departure", "leg_arrival", *[F.coalesce(c, zero).alias(c) for c in ("road_time", "in_time", "out_time")], none.cast("double").alias("exp_arrival"), ends.alias("trip_arrival"),
        F.when(is_road, F.coalesce(F.transform("way", lambda x: x["edge_id"]), F.array().cast(f"array<{edge}>"))).otherwise(F.array().cast(f"array<{edge}>")).alias("edges"),
        F.coalesce(F.transform("way", lambda x: x["entry_time"]), F.array().cast("array<double>")).alias("entries"), none.cast(edge).alias("edge_id"), none.cast("double").alias("t"), none.cast("double").alias("y"),
    )
    seen = [done.select(F.lit(kind).alias("kind"), "edge_id", F.col(at).alias("t"), (F.col(to) - F.col(at)).alias("y")) for kind, at, to in (("entry", "reach_time", "entry_time"), ("exit", "at_exit", "exit_time"))]
    if dense:
        seen.append(done.select(F.lit("length").alias("kind"), "edge_id", F.col("entry_time").alias("t"), F.col("occupied").alias("y")))
    return cut(out, "within_day"), cut(functools.reduce(DataFrame.unionByName, seen), "observed")


def within_day(w: World, legs: DataFrame, graphs: dict) -> tuple[DataFrame, DataFrame]:
    """Realized legs, and observations (kind entry, exit or length; edge_id, t, y) of all edges.

    Where edges are only queues the times are found relationally.  Else trips fall into components by the edges of their routes, each
    one event simulation; if a trip routes itself at departure, all of them are one component.
    """
    road = w.p.road_network
    late = w.alternatives.select("agent_id", "alt_id", "pre_compute_route")
    legs = legs.join(late, ["agent_id", "alt_id"])
    routed = legs.where("class_type = 'Road'").select(F.col("agent_id").alias("trip_id"), F.explode("leg_route").alias("edge_id"))
    whole = legs.where("not pre_compute_route and class_type = 'Road' and class_route is null").isEmpty()
    if whole and _only_queues(w, legs):
        return within_day_queues(w, legs)
    edge = dict(w.edges.dtypes)["edge_id"] if w.edges is not None else "bigint"
    if whole and w.edges is not None and not routed.isEmpty():
        parts = components(routed).select(F.col("trip_id").alias("agent_id"), F.col("component").cast("string").alias("component"))
        legs = legs.join(parts, "agent_id", "left")
        # agents off the road need no company: they are dealt by hash
        legs = legs.withColumn("component", F.coalesce("component", F.concat(F.lit("~"), F.pmod(F.xxhash64("agent_id"), F.lit(256)).cast("string"))))
    else:
        legs = legs.withColumn("component", F.lit("all"))
    if w.edges is not None:
        types = w.vehicles.drop("row_index").withColumnRenamed("vehicle_id", "class_vehicle").drop("uvehicle")
        legs = legs.join(types, "class_vehicle", "left")
        network = [r.asDict() for r in w.edges.drop("row_index").orderBy("edge_id").collect()] if not routing.too_large(w.edges.select(pwl.constant(F.lit(0.0)).cast(pwl.TYPE).alias("ttf"))) else None
        if network is None:
            raise ValueError("the network is too large for one worker")
    else:
        network = []
    sent = w.agents.sparkSession.sparkContext.broadcast((network, graphs))
    spillback = bool(road and road.spillback)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, graph_of = sent.value
        edges = [_edge(r) for r in rows]
        vehicles: dict = {}
        trips = []
        for agent, g in group.sort_values(["departure", "agent_id", "trip_index"]).groupby("agent_id", sort=False):
            parts = []
            for r in g.sort_values("trip_index").to_dict("records"):
                if r["class_type"] == "Road":
                    v = vehicles.setdefault(r["class_vehicle"], _vehicle(r))
                    known = bool(r["pre_compute_route"]) or r["class_route"] is not None
                    parts.append(Leg(r["trip_index"], v, r["class_origin"], r["class_destination"], list(r["leg_route"]) if known else None, stopping=r["stopping_time"]))
                    parts[-1].uvehicle = r["uvehicle"]
                else:
                    spent = r["class_travel_time"]
                    parts.append(Leg(r["trip_index"], travel_time=(lambda t, s=0.0 if spent != spent or spent is None else spent: s), stopping=r["stopping_time"]))
            trips.append(Trip(agent, g["departure"].iloc[0], parts, g["origin_delay"].iloc[0]))
        pending = road.max_pending_duration if road else 0.0
        simulation = Simulation(edges, spillback, road.constrain_inflow if road else True, pending, road.backward_wave_speed if road else None, router=lambda leg, t: graph_of[leg.uvehicle].earliest_route(leg.origin, leg.destination, t))
        done = simulation.run(trips)
        out = []
        for r in done:
            for x in r.legs:
                out.append(("leg", r.trip, x.leg, x.departure, x.arrival, x.road_time, x.in_bottleneck, x.out_bottleneck, x.expected_arrival, r.arrival, [e for e, _ in x.route], [t for _, t in x.route], None, None, None))
        for e, kind, t, y in simulation.waits:
            out.append((kind, None, None, *[None] * 7, None, None, e, t, y))
        for e, t, y in simulation.lengths:
            out.append(("length", None, None, *[None] * 7, None, None, e, t, y))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    agent = dict(w.agents.dtypes)["agent_id"]
    with_delay = cut(legs.join(w.alternatives.select("agent_id", "alt_id", "origin_delay"), ["agent_id", "alt_id"]), "grouped")
    most = with_delay.groupBy("component").agg(F.sum(F.greatest(F.size(F.coalesce("leg_route", F.array())), F.lit(1))).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_LEGS:
        raise ValueError(f"{most} legs act on one another, more than one worker holds ({MOST_LEGS})")
    done = cut(with_delay.groupBy("component").applyInPandas(run, _OUT.format(agent=agent, edge=edge)), "within_day")
    nulled = done.select("kind", "agent_id", "trip_index", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("leg_departure", "leg_arrival", "road_time", "in_time", "out_time", "exp_arrival", "trip_arrival")], "edges", "entries", "edge_id", "t", "y")
    return nulled.where("kind = 'leg'"), nulled.where("kind <> 'leg'").select("kind", "edge_id", "t", "y")


def _vehicle(r: dict) -> Vehicle:
    kind, ub, coef, x, y = (r[f"speed_function_{k}"] for k in ("type", "upper_bound", "coef", "x", "y"))

    def speed(base: float) -> float:
        if kind == "UpperBound":
            return min(base, ub)
        if kind == "Multiplicator":
            return base * coef
        if kind == "Piecewise" and x[0] <= base <= x[-1]:
            return float(np.interp(base, x, y))
        return base

    return Vehicle(r["headway"], r["pce"], speed)


def _edge(r: dict) -> Edge:
    flow = None
    if r["bottleneck_flow"] is not None:
        flow = lambda t, f=r["bottleneck_flow"]: f
    elif r["bottleneck_flows"]:
        flow = lambda t, ts=r["bottleneck_times"], fs=r["bottleneck_flows"]: fs[max(int(np.searchsorted(ts, t, side="right")) - 1, 0)]
    return Edge(r["edge_id"], r["length"], r["speed"], r["lanes"], flow, density_rule(r), r["constant_travel_time"], r["overtaking"])


def simulated_weights(w: World, observed: DataFrame) -> DataFrame:
    """uvehicle, edge_id, ttf of the day: waits to enter and leave and travel at the observed lengths, on the recording grid."""
    start, end, step = float(w.p.period[0]), float(w.p.period[1]), float(w.p.road_network.recording_interval)
    table = w.edges.select("edge_id")
    zero = pwl.constant(F.lit(0.0)).cast(pwl.TYPE)
    for kind in ("entry", "exit", "length"):
        grid = gates.observe(observed.where(F.col("kind") == kind), ["edge_id"], "t", "y", start, end, step)
        built = pwl.build(grid, ["edge_id"], "x", "y", start).withColumnRenamed("ttf", f"seen_{kind}")
        table = table.join(built, "edge_id", "left").withColumn(f"seen_{kind}", F.coalesce(f"seen_{kind}", zero))
    both = cut(_open_edges(w).join(table, "edge_id").withColumn("base_speed", _base_speed()), "observed")
    road = gates.road_function(F.col("seen_length"), lambda y: _time_at(y, F.col("base_speed")), w.p.road_network.approximation_bound).cast(pwl.TYPE)
    both = cut(both.select("uvehicle", "edge_id", "seen_entry", "seen_exit", road.alias("road_ttf")), "road")
    ttf = gates.simulated_weights(F.col("seen_entry"), F.col("road_ttf"), F.col("seen_exit"))
    return cut(both.select("uvehicle", "edge_id", ttf.cast(pwl.TYPE).alias("ttf")), "simulated")


# --- results -------------------------------------------------------------------------------


def trip_results(w: World, expected: DataFrame, realized: DataFrame, free: DataFrame | None, graphs: dict, previous: DataFrame | None) -> DataFrame:
    """One row for each leg of the chosen trips, with utilities, times and, of road legs, routes."""
    real = realized.select("agent_id", "trip_index", F.col("leg_departure").alias("departure_time"), F.col("leg_arrival").alias("arrival_time"), "road_time", F.col("in_time").alias("in_bottleneck_time"), F.col("out_time").alias("out_bottleneck_time"), "exp_arrival", "trip_arrival", "edges", "entries")
    rows = expected.join(real, ["agent_id", "trip_index"])
    spent = F.col("arrival_time") - F.col("departure_time")
    poly = [F.col("constant_utility"), *[F.col(f"travel_utility_{k}") for k in ("one", "two", "three", "four")]]
    rows = rows.withColumn("travel_utility", scalars.travel_utility(spent, *poly, alpha=F.col("alpha"))).withColumn("schedule_utility", scalars.schedule_utility(F.col("arrival_time"), *_prefixed("schedule_utility").values()))
    is_road = F.col("class_type") == "Road"
    rows = rows.withColumn("nb_edges", F.when(is_road, F.size("edges")).cast("bigint")).withColumn("exp_arrival_time", F.when(is_road, F.coalesce("exp_arrival", F.col("departure_time") + F.col("leg_arrival") - F.col("leg_departure"))))
    rows = rows.withColumn("pre_exp_departure_time", F.when(is_road, F.col("leg_departure"))).withColumn("pre_exp_arrival_time", F.when(is_road, F.col("leg_arrival")))
    if free is not None:
        taken = rows.where(is_road).select("agent_id", "trip_index", "uvehicle", F.explode("edges").alias("edge_id")).join(free, ["uvehicle", "edge_id"]).join(w.edges.select("edge_id", "length"), "edge_id")
        sums = taken.groupBy("agent_id", "trip_index").agg(F.sum("length").alias("road_length"), F.sum("free_flow").alias("road_free_flow"))
        rows = rows.join(sums, ["agent_id", "trip_index"], "left")
        rows = rows.withColumn("length", F.when(is_road, F.coalesce("road_length", F.lit(0.0)))).withColumn("route_free_flow_travel_time", F.when(is_road, F.coalesce("road_free_flow", F.lit(0.0))))
        pairs = rows.where(is_road & F.col("class_route").isNull()).select("uvehicle", F.col("class_origin").alias("origin"), F.col("class_destination").alias("destination")).distinct()
        best = None
        ends = w.edges.select("edge_id", "source", "target")
        for u in graphs:
            own = free.where(F.col("uvehicle") == F.lit(u)).join(ends, "edge_id").select("edge_id", "source", "target", pwl.constant(F.col("free_flow")).cast(pwl.TYPE).alias("ttf"))
            asked = pairs.where(F.col("uvehicle") == F.lit(u)).select(F.struct("origin", "destination").alias("query_id"), "origin", "destination", F.lit(0.0).alias("departure_time")).withColumn("query_id", F.to_json("query_id"))
            found = routing.earliest_arrivals(asked, own, False).select(F.lit(u).alias("uvehicle"), F.col("origin").alias("class_origin"), F.col("destination").alias("class_destination"), F.col("arrival_time").alias("best_free_flow"))
            best = found if best is None else best.unionByName(found)
        if best is None:  # all routes are given
            rows = rows.withColumn("best_free_flow", F.lit(None).cast("double"))
        else:
            rows = rows.join(best, ["uvehicle", "class_origin", "class_destination"], "left")
        rows = rows.withColumn("global_free_flow_travel_time", F.when(is_road, F.when(F.col("class_route").isNotNull(), F.col("route_free_flow_travel_time")).otherwise(F.col("best_free_flow"))))
    else:
        rows = rows.withColumns(dict.fromkeys(("length", "route_free_flow_travel_time", "global_free_flow_travel_time"), F.lit(None).cast("double")))
    if previous is None:
        rows = rows.withColumns(dict.fromkeys(("departure_time_shift", "length_diff"), F.lit(None).cast("double")))
    else:
        old = previous.select("agent_id", "alt_id", "trip_index", F.col("departure_time").alias("old_departure"), F.col("edges").alias("old_edges"))
        rows = rows.join(old, ["agent_id", "alt_id", "trip_index"], "left").withColumn("departure_time_shift", F.col("departure_time") - F.col("old_departure"))
        if w.edges is not None:
            fresh = rows.where(is_road & F.col("old_edges").isNotNull()).select("agent_id", "trip_index", F.explode(F.array_except("edges", "old_edges")).alias("edge_id")).join(w.edges.select("edge_id", "length"), "edge_id")
            fresh = fresh.groupBy("agent_id", "trip_index").agg(F.sum("length").alias("new_length"))
            rows = rows.join(fresh, ["agent_id", "trip_index"], "left").withColumn("length_diff", F.when(is_road & F.col("old_edges").isNotNull(), F.coalesce("new_length", F.lit(0.0))))
        else:
            rows = rows.withColumn("length_diff", F.lit(None).cast("double"))
    return cut(rows, "trip_results")


TRIP_COLUMNS = ["agent_id", "trip_id", "trip_index", "departure_time", "arrival_time", "travel_utility", "schedule_utility", "departure_time_shift", "road_time", "in_bottleneck_time", "out_bottleneck_time", "route_free_flow_travel_time", "global_free_flow_travel_time", "length", "length_diff", "pre_exp_departure_time", "pre_exp_arrival_time", "exp_arrival_time", "nb_edges"]
_D = ("mean", "std", "min", "max")
ITERATION_FIGURES = {
    "surplus": 4, "trip_alt_count": 1, "alt_departure_time": 4, "alt_arrival_time": 4, "alt_travel_time": 4, "alt_utility": 4, "alt_expected_utility": 4, "alt_dep_time_shift": 4, "alt_dep_time_rmse": 1,
    "road_trip_count": 1, "nb_agents_at_least_one_road_trip": 1, "nb_agents_all_road_trips": 1, "road_trip_count_by_agent": 4, "road_trip_departure_time": 4, "road_trip_arrival_time": 4, "road_trip_road_time": 4,
    "road_trip_in_bottleneck_time": 4, "road_trip_out_bottleneck_time": 4, "road_trip_travel_time": 4, "road_trip_route_free_flow_travel_time": 4, "road_trip_global_free_flow_travel_time": 4,
    "road_trip_route_congestion": 4, "road_trip_global_congestion": 4, "road_trip_length": 4, "road_trip_edge_count": 4, "road_trip_utility": 4, "road_trip_exp_travel_time": 4,
    "road_trip_exp_travel_time_rel_diff": 4, "road_trip_exp_travel_time_abs_diff": 4, "road_trip_exp_travel_time_diff_rmse": 1, "road_trip_length_diff": 4,
    "virtual_trip_count": 1, "nb_agents_at_least_one_virtual_trip": 1, "nb_agents_all_virtual_trips": 1, "virtual_trip_count_by_agent": 4, "virtual_trip_departure_time": 4, "virtual_trip_arrival_time": 4,
    "virtual_trip_travel_time": 4, "virtual_trip_global_free_flow_travel_time": 4, "virtual_trip_global_congestion": 4, "virtual_trip_utility": 4, "no_trip_alt_count": 1, "constant_utility": 4,
    "sim_road_network_cond_rmse": 1, "exp_road_network_cond_rmse": 1,
}
ITERATION_COLUMNS = ["iteration_counter", *(c for name, n in ITERATION_FIGURES.items() for c in ([name] if n == 1 else [f"{name}_{k}" for k in _D]))]
AGENT_COLUMNS = ["agent_id", "selected_alt_id", "expected_utility", "shifted_alt", "departure_time", "arrival_time", "total_travel_time", "utility", "alt_expected_utility", "departure_time_shift", "nb_road_trips", "nb_virtual_trips"]


def agent_results(w: World, choices: DataFrame, trips: DataFrame | None, previous: DataFrame | None) -> DataFrame:
    """One row for each agent."""
    base = choices.select("agent_id", "alt_id", F.col("alt_id").alias("selected_alt_id"), "expected_utility", F.col("departure").alias("departure_time"), "alt_expected_utility")
    kept = w.alternatives.select("agent_id", "alt_id", "constant_utility", "alpha", *[c for c in w.alternatives.columns if c.startswith(("total_travel_utility_", "origin_utility_", "destination_utility_"))])
    rows = base.join(kept, ["agent_id", "alt_id"])
    if trips is None:
        rows = rows.withColumns(dict.fromkeys(("arrival_time", "total_travel_time", "legs_utility"), F.lit(None).cast("double"))).withColumns(dict.fromkeys(("nb_road_trips", "nb_virtual_trips"), F.lit(None).cast("bigint")))
    else:
        road = F.col("class_type") == "Road"
        sums = trips.groupBy("agent_id").agg(
            F.max("trip_arrival").alias("arrival_time"), F.sum(F.col("arrival_time") - F.col("departure_time")).alias("total_travel_time"), F.sum(F.col("travel_utility") + F.col("schedule_utility")).alias("legs_utility"),
            F.count_if(road).alias("nb_road_trips"), F.count_if(~road).alias("nb_virtual_trips"),
        )
        rows = rows.join(sums, "agent_id", "left")
    whole = scalars.travel_utility(F.col("total_travel_time"), F.col("constant_utility"), *[F.col(f"total_travel_utility_{k}") for k in ("one", "two", "three", "four")], alpha=F.col("alpha"))
    sides = scalars.schedule_utility(F.col("departure_time"), *_prefixed("origin_utility").values()) + scalars.schedule_utility(F.col("arrival_time"), *_prefixed("destination_utility").values())
    rows = rows.withColumn("utility", F.when(F.col("departure_time").isNull(), F.col("constant_utility")).otherwise(F.col("legs_utility") + whole + sides))
    if previous is None:
        rows = rows.withColumn("shifted_alt", F.lit(False)).withColumn("departure_time_shift", F.lit(None).cast("double"))
    else:
        rows = rows.join(summary.previous_differences(rows, previous), "agent_id")
    return cut(rows.select(*AGENT_COLUMNS), "agent_results")


def route_rows(trips: DataFrame) -> DataFrame:
    """agent_id, trip_id, trip_index, edge_id, entry_time, exit_time: exit is the next edge's entry, of the last one the arrival."""
    steps = trips.where("class_type = 'Road'").select("agent_id", "trip_id", "trip_index", "arrival_time", F.posexplode(F.arrays_zip("edges", "entries")).alias("k", "s"), "entries")
    return steps.select("agent_id", "trip_id", "trip_index", F.col("s.edges").alias("edge_id"), F.col("s.entries").alias("entry_time"), F.coalesce(F.get("entries", F.col("k") + 1), "arrival_time").alias("exit_time"))


def iteration_row(counter: int, agents: DataFrame, trips: DataFrame | None, weights: list[DataFrame] | None) -> DataFrame:
    """One row of aggregates; figures without a basis are null.  ``weights``: simulated, previous simulated, expected."""
    timed = agents.where("departure_time is not null")
    row = agents.agg(F.lit(counter).alias("iteration_counter"), *summary.distribution(F.col("expected_utility"), "surplus"))
    row = row.crossJoin(timed.agg(*summary.trip_aggregates(timed)))
    still = agents.where("departure_time is null")
    if trips is not None:
        for kind, name, aggregate in (("Road", "road_trip", summary.road_trip_aggregates), ("Virtual", "virtual_trip", summary.virtual_trip_aggregates)):
            own = trips.where(F.col("class_type") == kind)
            others = agents.where("nb_road_trips + nb_virtual_trips > 0")
            only = others.agg(F.count_if(F.col("nb_virtual_trips" if kind == "Road" else "nb_road_trips") == 0).alias(f"nb_agents_all_{name}s"))
            by_agent = summary.by_agent(own, name).withColumnRenamed(f"nb_agents_at_least_one_{name}", f"nb_agents_at_least_one_{name}")
            row = row.crossJoin(aggregate(own)).crossJoin(by_agent).crossJoin(only)
    row = row.crossJoin(still.agg(F.count("*").alias("no_trip_alt_count"), *summary.distribution(F.col("utility"), "constant_utility")))
    if weights is not None:
        sim, before, exp = weights
        row = row.crossJoin(learning.weights_rmse(sim, before).withColumnRenamed("rmse", "sim_road_network_cond_rmse")).crossJoin(learning.weights_rmse(sim, exp).withColumnRenamed("rmse", "exp_road_network_cond_rmse"))
    for column in ITERATION_COLUMNS:
        if column not in row.columns:
            row = row.withColumn(column, F.lit(None).cast("bigint" if "count" in column and not column.endswith(_D) or column.startswith("nb_") else "double"))
    return cut(row.select(*ITERATION_COLUMNS), "iteration")


def sampled(w: World, weights: DataFrame) -> DataFrame:
    """vehicle_id, edge_id, departure_time, travel_time on the recording grid, for every original vehicle."""
    each = weights.join(F.broadcast(w.vehicles.select("vehicle_id", "uvehicle")), "uvehicle")
    points = F.explode(pwl.sample(F.col("ttf"), float(w.p.period[0]), float(w.p.period[1]), float(w.p.road_network.recording_interval)))
    return each.select("vehicle_id", "edge_id", points.alias("s")).select("vehicle_id", "edge_id", "s.departure_time", "s.travel_time")


def run(spark: SparkSession, parameters: SimulationParameters | str) -> dict:
    """Run all iterations and write the outputs; returns running times."""
    p = simulation_parameters(parameters) if isinstance(parameters, str) else parameters
    out, times, began = p.output_directory, {}, time.time()

    def spend(stage: str, since: float) -> float:
        now = time.time()
        times[stage] = times.get(stage, 0.0) + now - since
        return now

    w = load(spark, p)
    on_road = w.edges is not None
    free = cut(free_flow(w), "free_flow") if on_road else None
    weights = initial_weights(spark, w, free) if on_road else None
    if p.only_compute_decisions:
        graphs = _graphs(w, weights) if on_road else {}
        _write_decisions(w, decide(w, weights, graphs), weights, free, graphs)
        sinks.write_json({"total": time.time() - began}, f"{out}/running_times.json")
        return times
    previous_agents = previous_trips = previous_sim = previous_choices = None
    counter, iterations, figures = p.init_iteration_counter, 0, []
    while True:
        at = time.time()
        graphs = _graphs(w, weights) if on_road else {}
        at = spend("skims", at)
        choices = decide(w, weights, graphs)
        if previous_choices is not None and p.update_ratio < 1:
            mask = choice.update_mask(w.agents, "agent_id", p.update_ratio, p.random_seed if p.random_seed is not None else int(began), counter)
            updated = mask.where("updates").select("agent_id")
            choices = cut(choices.join(updated, "agent_id", "left_semi").unionByName(previous_choices.join(updated, "agent_id", "left_anti")), "choices")
        at = spend("demand", at)
        trips = None
        sim = None
        if w.legs is not None:
            expected = expected_legs(w, choices, weights, graphs)
            realized, observed = within_day(w, expected, graphs)
            if on_road:
                sim = simulated_weights(w, observed)
            trips = trip_results(w, expected, realized, free, graphs, previous_trips)
        at = spend("supply", at)
        following = learning.learn_weights(weights, sim, p.learning_model.type, counter + 1, p.learning_model.value) if sim is not None else None
        following = cut(following, "weights") if following is not None else None
        at = spend("learning", at)
        agents = agent_results(w, choices, trips, previous_agents)
        row = iteration_row(counter, agents, trips, [sim, previous_sim if previous_sim is not None else weights, weights] if sim is not None else None)
        write = sinks.write_table if iterations == 0 else sinks.append_rows
        write(row, out, "iteration_results", p.saving_format)
        figures.append(row.first().asDict())
        iterations += 1
        spend("aggregation", at)
        if learning.stop(counter, p.init_iteration_counter, p.max_iterations):
            break
        previous_agents, previous_trips, previous_sim, previous_choices = agents, trips, sim, choices
        weights = following if following is not None else weights
        counter += 1
    sinks.write_table(agents, out, "agent_results", p.saving_format)
    histograms: dict = {}
    if trips is not None:
        sinks.write_table(trips.select(*TRIP_COLUMNS), out, "trip_results", p.saving_format)
        sinks.write_table(route_rows(trips), out, "route_results", p.saving_format)
        for column in ("departure_time", "arrival_time"):
            bins = cut(summary.histogram(trips.select(F.col(column).alias("x")), "x", *map(float, p.period)), "histogram")
            sinks.write_table(bins, out, f"{column}_histogram", p.saving_format)
            histograms[column.replace("_", " ").capitalize()] = [(r.bin_start, r.bin_end, r["count"]) for r in bins.orderBy("bin").collect()]
    if sim is not None:
        for name, table in (("exp", weights), ("sim", sim), ("next_exp", following)):
            sinks.write_table(sampled(w, table), out, f"net_cond_{name}_edge_ttfs", p.saving_format)
    if w.skims is not None:
        sinks.write_json_rows(w.skims.select("uvehicle", "origin", "destination", "ttf"), "uvehicle", f"{out}/skim_results.json.zst")
    report.write_report(figures, histograms, out)
    times["total"] = time.time() - began
    sinks.write_json(times | {"per_iteration": {k: v / iterations for k, v in times.items()}}, f"{out}/running_times.json")
    return times


def _write_decisions(w: World, choices: DataFrame, weights, free, graphs) -> None:
    """Outputs of a run that only decides."""
    p, out = w.p, w.p.output_directory
    agents = choices.select("agent_id", F.col("alt_id").alias("selected_alt_id"), "expected_utility", F.col("departure").alias("departure_time"), "alt_expected_utility")
    if w.legs is None:
        none = F.lit(None).cast("bigint")
        sinks.write_table(agents.select("*", none.alias("nb_road_trips"), none.alias("nb_virtual_trips")), out, "agent_results", p.saving_format)
        return
    legs = expected_legs(w, choices, weights, graphs)
    counts = legs.groupBy("agent_id").agg(F.count_if(F.col("class_type") == "Road").alias("nb_road_trips"), F.count_if(F.col("class_type") == "Virtual").alias("nb_virtual_trips"))
    sinks.write_table(agents.join(counts, "agent_id", "left"), out, "agent_results", p.saving_format)
    steps = legs.select("agent_id", "trip_index", F.col("leg_departure"), F.col("leg_arrival"), F.lit(None).cast("double").alias("road_time"), F.lit(None).cast("double").alias("in_time"), F.lit(None).cast("double").alias("out_time"), F.lit(None).cast("double").alias("exp_arrival"), F.col("leg_arrival").alias("trip_arrival"), F.col("leg_route").alias("edges"), F.lit(None).cast("array<double>").alias("entries"))
    trips = trip_results(w, legs, steps, free, graphs, None)
    columns = ["agent_id", "trip_id", "trip_index", "route_free_flow_travel_time", "global_free_flow_travel_time", "length", "pre_exp_departure_time", "pre_exp_arrival_time", "nb_edges"]
    sinks.write_table(trips.select(*columns), out, "trip_results", p.saving_format)
    if weights is not None:
        way = trips.where("class_type = 'Road'").select("agent_id", "trip_id", "trip_index", "uvehicle", "leg_departure", "leg_arrival", F.posexplode("edges").alias("k", "edge_id")).join(weights, ["uvehicle", "edge_id"])
        listed = way.groupBy("agent_id", "trip_id", "trip_index", "leg_departure", "leg_arrival").agg(F.sort_array(F.collect_list(F.struct("k", "edge_id", "ttf"))).alias("way"))
        entered = F.aggregate("way", F.array("leg_departure"), lambda ts, s: F.concat(ts, F.array(F.element_at(ts, -1) + pwl.evaluate(s["ttf"], F.element_at(ts, -1)))))
        rows = listed.withColumn("entries", entered).select("agent_id", "trip_id", "trip_index", "entries", "leg_arrival", F.posexplode("way").alias("k", "s"))
        last = F.col("k") == F.size("entries") - 2
        sinks.write_table(rows.select("agent_id", "trip_id", "trip_index", F.col("s.edge_id").alias("edge_id"), F.get("entries", "k").alias("entry_time"), F.when(last, F.col("leg_arrival")).otherwise(F.get("entries", F.col("k") + 1)).alias("exit_time")), out, "route_results", p.saving_format)
