"""The within-day model over tables.

Without spillback an edge only makes vehicles wait at its gates, in order.  ``queue_network`` then finds all times by rounds of window
functions over edges and trips, with no group larger than a stretch of time of one edge.  With spillback an edge acts back on those before
it; trips are split into components that share edges, and each is one event simulation, which must fit in a worker.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import scalars
from wayfare.sources.shared import cut, drop
from wayfare.streaming import gates
from wayfare.streaming.supply import Edge, Leg, Simulation, Trip, Vehicle, density_rule


def components(routes: DataFrame, rounds: int = 100) -> DataFrame:
    """trip_id, component: trips that are joined by shared edges.

    Each trip joins its edges to its least one; labels then spread over edges alone, of which there are far fewer than trips,
    and jump to the label of their label each round.
    """
    anchors = routes.groupBy("trip_id").agg(F.min("edge_id").alias("anchor"))
    pairs = routes.select("trip_id", "edge_id").join(anchors, "trip_id").select("edge_id", "anchor").distinct()
    links = cut(pairs.unionAll(pairs.select("anchor", "edge_id")).distinct(), "links")
    labels = cut(links.groupBy("edge_id").agg(F.min("anchor").alias("component")), "components")
    before = None
    for _ in range(rounds):
        near = links.join(labels.select(F.col("edge_id").alias("anchor"), "component"), "anchor").groupBy("edge_id").agg(F.min("component").alias("near"))
        least = labels.join(near, "edge_id").select("edge_id", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("edge_id").alias("component"), F.col("component").alias("jump"))
        labels = cut(least.join(jump, "component", "left").select("edge_id", F.least("component", "jump").alias("component")), "components")
        mark = labels.agg(F.sum(F.xxhash64("edge_id", "component").cast("decimal(38,0)"))).first()
        if mark == before:
            return anchors.join(labels, anchors["anchor"] == labels["edge_id"]).select("trip_id", "component")
        before = mark
    raise RuntimeError("components did not settle")


#: Legs on edges that one event simulation holds at most.
MOST_LEGS = 5_000_000
#: Seconds of the stretches that an edge's arrivals are summed up by, where one has more than ``MOST_AT_GATE`` of them.
CHUNK = 900.0
MOST_AT_GATE = 1_000_000
#: A round that does one edge after all its trips have come has to do this part of the legs that are left.
FEWEST_DONE = 16


def _at_the_start(departures: DataFrame, routes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each trip as one row with its time and its way as two arrays, and the edges that trips take with the number ``n`` of their legs."""
    ways = routes.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("position", "edge_id"))).alias("way"))
    starts = ways.join(departures.select("trip_id", F.col("departure").cast("double").alias("time")), "trip_id").select("trip_id", "time", F.col("way.position").alias("at"), F.col("way.edge_id").alias("roads"))
    waiting = cut(starts, "trips")
    counts = waiting.select(F.explode("roads").alias("edge_id")).groupBy("edge_id").agg(F.count("*").alias("n"))
    return waiting, cut(edges.join(counts, "edge_id"), "roads")


def _legs_left(waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """The legs of waiting trips as ``queue_steps`` takes them, on the edges that are known."""
    left = waiting.select("trip_id", F.col("time").alias("departure"), F.explode(F.arrays_zip("at", "roads")).alias("leg"))
    return left.select("trip_id", "departure", F.col("leg.at").alias("position"), F.col("leg.roads").alias("edge_id"), F.lit(0.0).alias("gap")).join(edges, "edge_id")


def queue_network(departures: DataFrame, routes: DataFrame, edges: DataFrame, constrain_inflow: bool = True, chunk: float = CHUNK) -> DataFrame:
    """trip_id, position, edge_id, reach_time, entry_time, at_exit, exit_time of trips with given routes, without spillback and at free flow.

    An edge is done once, when all trips over it have come to it; a trip moves from edge to edge as one row with the rest of its route.  Where
    too few edges are next (ways that go round, an edge of more than ``MOST_AT_GATE`` arrivals), the rest is done by the rounds of ``queue_steps``.
    """
    waits = scalars.closing_time(F.lit(1.0), F.col("flow"), F.col("lanes"))
    spent = scalars.edge_travel_time(F.col("length"), F.col("speed"), F.coalesce("constant_travel_time", F.lit(0.0)) if "constant_travel_time" in edges.columns else F.lit(0.0))
    known = edges.select("edge_id", spent.alias("spent"), waits.alias("closing"))
    waiting, known = _at_the_start(departures, routes, known)
    most, legs = known.agg(F.max("n"), F.sum("n")).first()
    settled: list[DataFrame] = []
    while (most or 0) <= MOST_AT_GATE:
        # roads that the network does not have pass at once; the join by edge is the only shuffle
        here = waiting.select("trip_id", "time", "at", "roads", F.get("roads", F.lit(0)).alias("edge_id")).join(known.hint("merge"), "edge_id", "left")
        rows = here.withColumn("position", F.struct("trip_id", F.get("at", F.lit(0)).alias("place"))).withColumn("ready", F.col("n").isNull() | (F.count("*").over(Window.partitionBy("edge_id")) == F.col("n")))
        entered = gates.fifo_gate(rows, "edge_id", "time", F.col("closing"), None, "entry_time") if constrain_inflow else rows.withColumn("entry_time", F.col("time"))
        left = gates.fifo_gate(entered.withColumn("at_exit", F.col("entry_time") + F.col("spent")), "edge_id", "at_exit", F.col("closing"), None, "exit_time")
        done = F.col("ready") & F.col("n").isNotNull()
        rest = [F.when(F.col("ready"), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(F.col(c)).alias(c) for c in ("at", "roads")]
        # who does not wait at the exit leaves when it comes there, whatever the sums round to
        left = left.withColumn("exit_time", F.when(F.col("exit_time") - F.col("at_exit") < 1e-8, F.col("at_exit")).otherwise(F.col("exit_time")))
        times = [F.when(done, F.col(c)).alias(c) for c in ("entry_time", "at_exit", "exit_time")]
        step = cut(left.select("trip_id", F.get("at", F.lit(0)).alias("position"), "edge_id", F.col("time").alias("reach_time"), *times, "ready", *rest), "queue")
        settled.append(step.where("exit_time is not null").select("trip_id", "position", "edge_id", "reach_time", "entry_time", "at_exit", "exit_time"))
        waiting = step.where("size(roads) > 0").select("trip_id", F.coalesce("exit_time", "reach_time").alias("time"), "at", "roads")
        moved, more = step.agg(F.count_if("ready"), F.count_if(F.size("roads") > 0)).first()
        if not more:
            break
        before, legs = legs, legs - moved
        if moved * FEWEST_DONE < before:
            break
    else:
        more = 1
    if more:
        settled.append(queue_steps(_legs_left(waiting, known.drop("n")), constrain_inflow, chunk).select("trip_id", "position", "edge_id", "reach_time", "entry_time", "at_exit", "exit_time"))
    return functools.reduce(DataFrame.unionByName, settled)


_DENSITY = tuple(f"speed_density_{c}" for c in ("type", "capacity", "min_density", "jam_density", "jam_speed", "beta"))


def dense_network(departures: DataFrame, routes: DataFrame, edges: DataFrame, headway: float = 7.0, wave_speed: float | None = None) -> DataFrame:
    """trip_id, position, edge_id, entry_time, exit_time of trips with given routes over edges without gates whose speed falls with the vehicles on them.

    ``edges`` has edge_id, length, speed, lanes and the columns speed_density_*.  An edge is done once, when all trips over it have come to it: one pass over
    its arrivals in the order of time and trip, which keeps the times at which those on it free their length.  Where too few edges are next (ways that
    go round), the rest is done by the rounds of ``queue_steps``.
    """
    wave = F.col("length") / wave_speed if wave_speed else F.lit(0.0)
    constant = F.coalesce("constant_travel_time", F.lit(0.0)) if "constant_travel_time" in edges.columns else F.lit(0.0)
    road = F.struct("length", "speed", "lanes", constant.alias("constant_travel_time"), wave.cast("double").alias("wave"), *_DENSITY)
    waiting, known = _at_the_start(departures, routes, edges.select("edge_id", road.alias("road")))
    legs = known.agg(F.sum("n")).first()[0] or 0
    settled: list[DataFrame] = []
    while True:
        # the count by edge keeps the rows of an edge in one task; roads that the network does not have pass at once
        here = waiting.select("trip_id", "time", "at", "roads", F.get("roads", F.lit(0)).alias("edge_id")).join(known.hint("merge"), "edge_id", "left")
        come = here.withColumn("ready", F.col("n").isNull() | (F.count("*").over(Window.partitionBy("edge_id")) == F.col("n"))).withColumn("place", F.get("at", F.lit(0)))
        ordered = come.sortWithinPartitions("edge_id", "time", "trip_id", "place")
        columns = ordered.select("edge_id", "time", "trip_id", "place", "at", "roads", F.when(F.col("ready"), F.col("road")).alias("road"), "ready")
        schema = ", ".join(f"{c} {columns.schema[c].dataType.simpleString()}" for c in columns.columns if c != "road")
        left = columns.mapInArrow(functools.partial(_pass_dense, headway=headway), f"{schema}, exit_time double")
        rest = [F.when(F.col("ready"), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(F.col(c)).alias(c) for c in ("at", "roads")]
        step = cut(left.select("trip_id", F.col("place").alias("position"), "edge_id", F.col("time").alias("entry_time"), "exit_time", "ready", *rest), "queue")
        settled.append(step.where("exit_time is not null").select("trip_id", "position", "edge_id", "entry_time", "exit_time"))
        waiting = step.where("size(roads) > 0").select("trip_id", F.coalesce("exit_time", "entry_time").alias("time"), "at", "roads")
        moved, more = step.agg(F.count_if("ready"), F.count_if(F.size("roads") > 0)).first()
        if not more:
            break
        before, legs = legs, legs - moved
        if moved * FEWEST_DONE < before:
            break
    if more:
        free = scalars.edge_travel_time(F.col("length"), F.col("speed"), F.col("constant_travel_time"))
        rows = _legs_left(waiting, known.select("edge_id", "road.*")).withColumns({"spent": free, "closing": F.lit(0.0), "headway": F.lit(float(headway))})

        def spent_at(occupied):
            speed = scalars.congested_speed(F.col("speed"), occupied, F.col("length") * F.col("lanes"), *[F.col(c) for c in _DENSITY])
            return scalars.edge_travel_time(F.col("length"), speed, F.col("constant_travel_time"))

        settled.append(queue_steps(rows, spent_at=spent_at).select("trip_id", "position", "edge_id", "entry_time", "exit_time"))
    return functools.reduce(DataFrame.unionByName, settled)


def _pass_dense(batches: Iterator[pa.RecordBatch], headway: float) -> Iterator[pa.RecordBatch]:
    """``exit_time`` of arrivals that come edge by edge in their order; null where the edge is not known or not all have come to it."""
    last, leaving, road = None, [], None
    for batch in batches:
        roads, exits = batch.column("road"), []
        known = roads.is_valid().to_pylist()
        for k, (edge, t) in enumerate(zip(batch.column("edge_id").to_pylist(), batch.column("time").to_pylist(), strict=True)):
            if not known[k]:
                exits.append(None)
                continue
            if road is None or edge != last:
                last, leaving, road = edge, [], roads[k].as_py()
                rule, room = density_rule(road), road["length"] * road["lanes"]
            while leaving and leaving[0] <= t:
                heapq.heappop(leaving)
            speed = rule(road["speed"], headway * len(leaving), room) if rule else road["speed"]
            end = t + (road["length"] / speed + road["constant_travel_time"])
            heapq.heappush(leaving, end + road["wave"])
            exits.append(end)
        kept = [c for c in batch.schema.names if c != "road"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(exits, pa.float64())], names=[*kept, "exit_time"])


def queue_steps(rows: DataFrame, constrain_inflow: bool = True, chunk: float = CHUNK, rounds: int = 10_000, spent_at=None) -> DataFrame:
    """The rows (trip_id, position, edge_id, departure of the trip, gap before the edge, spent on it, closing of its gates) with reach_time, entry_time, at_exit, exit_time.

    A vehicle waits at the entry gate (with ``constrain_inflow``) and at the exit gate of an edge, first come, first served, of equal times in the order of
    trip_id and position.  Rows with ``flow_times`` and ``closings`` (arrays) have gates that change with time.  With ``spent_at``, a function of the column ``occupied``, the time on
    an edge is by the length of the vehicles on it at the entry (``headway`` each, until they enter the next edge or end, and ``wave`` seconds more); ``spent`` is that of an empty one.
    Where a column ``ordered`` is true vehicles cannot overtake at the exit: the gate stays shut behind one until it has entered its next edge, and closes from then on.
    Such rows have a constant ``closing``.  A column ``leg`` splits a trip into drives; the last edge of one is left at its exit.

    Each round computes all gates, and lengths, from the times of the last one, at first those of an empty network.  A time
    depends only on earlier ones, and a way over an edge takes time, so that each round settles more of them for good, and the times
    that a round leaves unchanged are the only solution.
    """
    by_trip = Window.partitionBy("trip_id").orderBy("place")
    whole = F.sum(F.col("gap") + F.col("spent")).over(by_trip.rowsBetween(Window.unboundedPreceding, 0))
    by_leg = Window.partitionBy("trip_id", "leg").orderBy("place")
    ordered = "ordered" in rows.columns
    placed = rows if "leg" in rows.columns else rows.withColumn("leg", F.lit(0))
    placed, ties = placed.withColumnRenamed("position", "place"), ("trip_id", "place")
    if ordered:
        placed = placed.withColumn("held_until", F.lit(None).cast("double"))
    now = placed.withColumn("reach_time", F.col("departure") + whole - F.col("spent"))
    if spent_at is not None:
        now = now.withColumn("freed_time", F.col("reach_time") + F.col("spent") + F.col("wave")).withColumn("occupied", F.lit(0.0))
    held = now = cut(now, "queue")
    sizes = now.groupBy("edge_id").agg(F.count("*").alias("n"), F.max(F.size("flow_times") if "flow_times" in now.columns else F.lit(1)).alias("stages")).agg(F.max("n").alias("n"), F.max("stages").alias("stages")).first()
    chunk = chunk if (sizes.n or 0) > MOST_AT_GATE else None

    def gate(df: DataFrame, time: str, name: str, held: str | None = None) -> DataFrame:
        if "flow_times" in df.columns:
            return gates.fifo_gate_varying(df, "edge_id", time, "flow_times", "closings", sizes.stages or 1, name, held, ties)
        return gates.fifo_gate(df, "edge_id", time, F.col("closing"), chunk, name, held, ties)

    for _ in range(rounds):
        entered = gate(now, "reach_time", "entry_time") if constrain_inflow else now.withColumn("entry_time", F.col("reach_time"))
        if spent_at is not None:
            entered = gates.occupied_at_entry(entered.drop("occupied"), "edge_id", "entry_time", "freed_time", "headway", ties=ties)
            entered = entered.withColumn("spent", spent_at(F.col("occupied")))
        left = gate(entered.withColumn("at_exit", F.col("entry_time") + F.col("spent")), "at_exit", "exit_time", "held_until" if ordered else None)
        # what a round leaves is moved and written as few columns: ``at_exit`` follows from two others
        left = left.drop("at_exit").withColumn("next_reach", F.coalesce(F.lag("exit_time").over(by_trip), F.col("departure")) + F.col("gap"))
        moved = F.abs(F.col("next_reach") - F.col("reach_time")) > 1e-7
        if spent_at is not None:
            left = left.withColumn("next_freed", F.coalesce(F.lead("entry_time").over(by_leg), F.col("exit_time")) + F.col("wave"))
            moved = moved | (F.abs(F.col("next_freed") - F.col("freed_time")) > 1e-7)
        if ordered:
            # the entry as this round finds it: a time, not a wait, so that a whole queue settles at once
            left = left.withColumn("next_held", F.when(F.col("ordered"), F.lead("entry_time").over(by_leg) + F.col("closing")))
            moved = moved | (F.abs(F.col("next_held") - F.coalesce("held_until", F.lit(float("-inf")))) > 1e-7)
        left = left.withColumn("moved", F.coalesce(moved, F.lit(False))).drop("held_until")
        timed = cut(left.withColumn("next_reach", F.nullif("next_reach", "reach_time")), "queue")
        drop(held)  # the table of the round before
        held = timed
        if timed.where("moved").isEmpty():
            return timed.withColumnRenamed("place", "position").withColumn("at_exit", F.col("entry_time") + F.col("spent")).drop("moved", "next_reach", "next_freed", "next_held", "leg")
        now = timed.withColumn("reach_time", F.coalesce("next_reach", "reach_time")).drop("moved", "next_reach", "entry_time", "exit_time")
        if spent_at is not None:
            now = now.withColumn("freed_time", F.col("next_freed")).drop("next_freed")
        if ordered:
            now = now.withColumn("held_until", F.col("next_held")).drop("next_held")
    raise RuntimeError("the times did not settle")


def simulate_routes(departures: DataFrame, routes: DataFrame, edges: DataFrame, headway: float = 7.0, spillback: bool = False, constrain_inflow: bool = True, **options) -> DataFrame:
    """trip_id, arrival_time, road_time, in_bottleneck_time, out_bottleneck_time of trips with given routes.

    ``edges`` has edge_id, length, speed, lanes, flow.  Without spillback this is ``queue_network``; with it, ``simulate_events``.
    """
    if spillback or options:
        return simulate_events(departures, routes, edges, headway, spillback=spillback, constrain_inflow=constrain_inflow, **options)
    rows = queue_network(departures, routes, edges, constrain_inflow)
    return rows.groupBy("trip_id").agg(
        F.max("exit_time").alias("arrival_time"), F.sum(F.col("at_exit") - F.col("entry_time")).alias("road_time"),
        F.sum(F.col("entry_time") - F.col("reach_time")).alias("in_bottleneck_time"), F.sum(F.col("exit_time") - F.col("at_exit")).alias("out_bottleneck_time"),
    )


def simulate_events(departures: DataFrame, routes: DataFrame, edges: DataFrame, headway: float = 7.0, **options) -> DataFrame:
    """The same by the event model, one group for each component of trips; one of more than ``MOST_LEGS`` legs is an error.

    The edges join the rows of their component, so that no task sees all of them.
    """
    parts = cut(components(routes), "components")
    most = routes.join(parts, "trip_id").groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_LEGS:
        raise ValueError(f"{most} legs share edges with one another, more than one worker holds ({MOST_LEGS})")
    rows = routes.join(departures, "trip_id").join(edges.select("edge_id", "length", "speed", "lanes", "flow"), "edge_id").join(parts, "trip_id")
    trip = dict(departures.dtypes)["trip_id"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["trip_id", "position"])
        flows = ordered.drop_duplicates("edge_id").sort_values("edge_id")
        listed = [Edge(r.edge_id, r.length, r.speed, r.lanes, (lambda t, f=r.flow: f) if r.flow == r.flow and r.flow else None) for r in flows.itertuples()]
        ids, starts, taken = ordered["trip_id"].tolist(), ordered["departure"].tolist(), ordered["edge_id"].tolist()
        vehicle, trips, first = Vehicle(headway), [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or ids[k] != ids[first]:
                trips.append(Trip(ids[first], starts[first], [Leg(1, vehicle, route=taken[first:k])]))
                first = k
        done = Simulation(listed, **options).run(trips)
        return pd.DataFrame([(r.trip, r.arrival, r.legs[0].road_time, r.legs[0].in_bottleneck, r.legs[0].out_bottleneck) for r in done], columns=["trip_id", "arrival_time", "road_time", "in_bottleneck_time", "out_bottleneck_time"])

    return rows.groupBy("component").applyInPandas(run, f"trip_id {trip}, arrival_time double, road_time double, in_bottleneck_time double, out_bottleneck_time double")
