"""Queries of a simulated day: customers who drive along a ring of roads, ride, or stay at home."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import choice
from wayfare.plans import derived as d
from wayfare.plans import simulation
from wayfare.plans.catalogue import query, r6
from wayfare.plans.parameters import LearningModel, RoadNetwork, SimulationParameters
from wayfare.sources import tables
from wayfare.sources.shared import cut_sized as cut

#: Roads of a drive: from the customer's node on, two to four along the ring (the even edges).
_KEY = "c_custkey"
PERIOD = (0.0, 86400.0)
CROWDED_FLOW = 0.001


def _world(spark, sf_dir, crowded: bool = False) -> simulation.World:
    """The derived world; ``crowded``, every fifth node's road along the ring lets a vehicle in and out each thousand seconds and lane."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(_KEY)
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    key = F.col(_KEY)

    def placed(df: DataFrame, row) -> DataFrame:
        return df.withColumn("row_index", F.struct(F.lit("").alias("file"), row.cast("bigint").alias("row")))

    kind = F.when(key % 3 == 0, "Deterministic").when(key % 3 == 1, "Logit")
    agents = c.select(key.alias("agent_id"), kind.alias("alt_choice.type"), ((key * 7919) % 1000 / 1000.0).alias("alt_choice.u"), (1.0 + key % 2).alias("alt_choice.mu"), F.when(key % 3 == 0, F.lit([0.0, 0.5])).alias("alt_choice.constants"))
    alts = c.select(key, F.explode(F.lit([0, 1, 2])).alias("alt"))
    drives, rides = F.col("alt") == 0, F.col("alt") == 1
    leaves = F.when(drives, (key * 37) % 43200 + 600).when(rides, (key * 11) % 43200).cast("double")
    alternatives = alts.select(
        key.alias("agent_id"), F.col("alt").cast("bigint").alias("alt_id"), F.when(drives, (key % 60).cast("double")).alias("origin_delay"), F.when(leaves.isNotNull(), "Constant").alias("dt_choice.type"), leaves.alias("dt_choice.departure_time"),
        F.when(drives, (key % 11) / 2.0).when(rides, F.lit(1.0)).otherwise((key % 7) / 4.0 - 1.0).alias("constant_utility"), F.when(drives, F.lit(0.0005)).alias("alpha"),
        F.when(drives, "Linear").alias("destination_utility.type"), F.when(drives, 40000.0).alias("destination_utility.tstar"), F.when(drives, 1e-4).alias("destination_utility.beta"), F.when(drives, 2e-4).alias("destination_utility.gamma"),
    )
    route = F.transform(F.sequence(F.lit(0), (key % 3 + 1).cast("int")), lambda i: 2 * ((key + i) % n))
    road = c.select(
        key.alias("agent_id"), F.lit(0).cast("bigint").alias("alt_id"), F.lit(0).cast("bigint").alias("trip_id"), F.lit("Road").alias("class.type"), (key % n).alias("class.origin"), ((key + key % 3 + 2) % n).alias("class.destination"),
        (key % 2).alias("class.vehicle"), route.alias("class.route"), F.lit(None).cast("double").alias("class.travel_time"), F.lit(30.0).alias("stopping_time"), F.lit(-0.002).alias("travel_utility.one"),
    )
    none = F.lit(None)
    walk = c.select(
        key.alias("agent_id"), F.lit(0).cast("bigint").alias("alt_id"), F.lit(1).cast("bigint").alias("trip_id"), F.lit("Virtual").alias("class.type"), none.cast("bigint").alias("class.origin"), none.cast("bigint").alias("class.destination"),
        none.cast("bigint").alias("class.vehicle"), none.cast("array<bigint>").alias("class.route"), F.lit(120.0).alias("class.travel_time"), F.lit(0.0).alias("stopping_time"), F.lit(-0.001).alias("travel_utility.one"),
    )
    ride = walk.withColumns({"alt_id": F.lit(1).cast("bigint"), "trip_id": F.lit(0).cast("bigint"), "class.travel_time": (600 + F.col("agent_id") % 900).cast("double"), "travel_utility.one": F.lit(-0.0015)})
    trips = road.unionByName(walk).unionByName(ride)
    edges = d.frame(spark, sf_dir, d.EDGES).select("edge_id", "source", "target", "speed", "length", "lanes", "constant_travel_time")
    if crowded:
        edges = edges.withColumn("bottleneck_flow", F.when(F.col("edge_id") % 10 == 0, F.lit(CROWDED_FLOW)))
    vehicles = spark.createDataFrame([(0, 8.0, "Base", None), (1, 16.0, "UpperBound", 9.0)], "`vehicle_id` bigint, `headway` double, `speed_function.type` string, `speed_function.upper_bound` double")
    given = {
        "agents": placed(agents, F.col("agent_id")), "alternatives": placed(alternatives, F.col("agent_id") * 3 + F.col("alt_id")), "trips": placed(trips, F.col("agent_id") * 6 + F.col("alt_id") * 2 + F.col("trip_id")),
        "edges": placed(edges, F.col("edge_id")), "vehicle_types": placed(vehicles, F.col("vehicle_id")),
    }
    p = SimulationParameters({}, PERIOD, road_network=RoadNetwork(3600.0, spillback=False), learning_model=LearningModel("Linear"))
    return simulation.world(spark, p, {name: cut(tables.read(table, name), name) for name, table in given.items()})


class _Day:
    """One iteration of the derived world, as the run loop makes it."""

    def __init__(self, spark, sf_dir, before: _Day | None = None, crowded: bool = False):
        self.w = before.w if before else _world(spark, sf_dir, crowded)
        self.free = before.free if before else cut(simulation.free_flow(self.w), "free_flow")
        self.weights = before.following if before else simulation.initial_weights(spark, self.w, self.free)
        graphs = simulation._graphs(self.w, self.weights)
        self.choices = simulation.decide(self.w, self.weights, graphs)
        self.expected = simulation.expected_legs(self.w, self.choices, self.weights, graphs)
        realized, self.observed = simulation.within_day(self.w, self.expected, graphs)
        self.simulated = simulation.simulated_weights(self.w, self.observed)
        self.trips = simulation.trip_results(self.w, self.expected, realized, self.free, graphs, before.trips if before else None)
        self.following = cut(simulation.learning.learn_weights(self.weights, self.simulated, "Linear", 2), "weights")
        self.agents = simulation.agent_results(self.w, self.choices, self.trips, before.agents if before else None)


_WORLD = """drive AS (SELECT c_custkey AS agent_id, ((c_custkey * 37) % 43200 + 600)::DOUBLE AS departure, (c_custkey % 60)::DOUBLE AS delay, (c_custkey % 11) / 2e0 AS bonus, c_custkey % 2 AS vehicle,
    sum(length / CASE WHEN c_custkey % 2 = 1 THEN least(speed, 9e0) ELSE speed END + constant_travel_time) AS spent, sum(length) AS road_length, count(*)::BIGINT AS nb_edges
  FROM customer JOIN (SELECT unnest([0, 1, 2, 3]) AS i) n ON i <= c_custkey % 3 + 1 JOIN <EDGES> e ON e.edge_id = 2 * ((c_custkey + i) % <NODES>) GROUP BY c_custkey),
  valued AS (SELECT agent_id, 0::BIGINT AS alt_id, departure, -0.002e0 * spent - 0.001e0 * 120e0 + bonus - 0.0005e0 * (spent + 120e0) - 0.0001e0 * greatest(40000e0 - (departure + delay + spent + 150e0), 0e0) - 0.0002e0 * greatest(departure + delay + spent + 150e0 - 40000e0, 0e0) AS value FROM drive
    UNION ALL SELECT c_custkey, 1, ((c_custkey * 11) % 43200)::DOUBLE, 1e0 - 0.0015e0 * (600 + c_custkey % 900) FROM customer UNION ALL SELECT c_custkey, 2, NULL, (c_custkey % 7) / 4e0 - 1e0 FROM customer),
  models AS (SELECT *, agent_id % 3 AS kind, ((agent_id * 7919) % 1000) / 1000e0 AS u, 1e0 + agent_id % 2 AS mu, max(value) OVER (PARTITION BY agent_id) AS m FROM valued),
  fixed AS (SELECT *, value + [0e0, 0.5e0][alt_id % 2 + 1] AS total FROM models WHERE kind = 0),
  logits AS (SELECT *, sum(exp((value - m) / mu)) OVER (PARTITION BY agent_id ORDER BY alt_id) AS c, sum(exp((value - m) / mu)) OVER (PARTITION BY agent_id) AS s FROM models WHERE kind = 1),
  picked AS (SELECT agent_id, arg_max(alt_id, total) AS alt_id, max(total) AS payoff FROM fixed GROUP BY agent_id UNION ALL
    SELECT agent_id, min(alt_id) FILTER (c / s > u OR alt_id = 2), any_value(m) + any_value(mu) * (ln(any_value(s)) + 0.5772156649015329e0) FROM logits GROUP BY agent_id UNION ALL SELECT agent_id, 0, value FROM models WHERE kind = 2 AND alt_id = 0),
  chosen AS (SELECT p.agent_id, p.alt_id, v.departure, v.value, p.payoff FROM picked p JOIN valued v ON v.agent_id = p.agent_id AND v.alt_id = p.alt_id),
  legs AS (SELECT c.agent_id, 0::BIGINT AS trip_id, 0 AS trip_index, 'Road' AS kind, c.departure + delay AS departure_time, c.departure + delay + spent AS arrival_time, -0.002e0 * spent AS travel_utility, spent, road_length, nb_edges FROM chosen c JOIN drive d ON d.agent_id = c.agent_id WHERE alt_id = 0
    UNION ALL SELECT c.agent_id, 1, 1, 'Virtual', c.departure + delay + spent + 30e0, c.departure + delay + spent + 150e0, -0.12e0, 120e0, NULL, NULL FROM chosen c JOIN drive d ON d.agent_id = c.agent_id WHERE alt_id = 0
    UNION ALL SELECT agent_id, 0, 0, 'Virtual', departure, departure + 600 + agent_id % 900, -0.0015e0 * (600 + agent_id % 900), 600 + agent_id % 900, NULL, NULL FROM chosen WHERE alt_id = 1)"""


@query(f"WITH {_WORLD} SELECT agent_id, alt_id, departure, round(value, 6) AS alt_expected_utility, round(payoff, 6) AS expected_utility FROM chosen")
def day_choices(spark, sf_dir):
    """What everybody decides before the day."""
    w = _world(spark, sf_dir)
    free = cut(simulation.free_flow(w), "free_flow")
    weights = simulation.initial_weights(spark, w, free)
    got = simulation.decide(w, weights, simulation._graphs(w, weights))
    return got.select("agent_id", "alt_id", "departure", r6("alt_expected_utility").alias("alt_expected_utility"), r6("expected_utility").alias("expected_utility"))


@query(
    f"""WITH {_WORLD} SELECT agent_id, trip_id, trip_index, round(departure_time, 6) AS departure_time, round(arrival_time, 6) AS arrival_time, round(travel_utility, 6) AS travel_utility, 0e0 AS schedule_utility,
  round(CASE WHEN kind = 'Road' THEN spent ELSE 0e0 END, 6) AS road_time, 0e0 AS waiting_time, round(CASE WHEN kind = 'Road' THEN spent END, 6) AS route_free_flow_travel_time, road_length AS length, nb_edges::DOUBLE AS nb_edges,
  round(CASE WHEN kind = 'Road' THEN departure_time END, 6) AS pre_exp_departure_time, round(CASE WHEN kind = 'Road' THEN arrival_time END, 6) AS exp_arrival_time FROM legs"""
)
def day_trip_results(spark, sf_dir):
    """One row for each leg of the trips taken."""
    t = _Day(spark, sf_dir).trips
    return t.select(
        "agent_id", "trip_id", "trip_index", *[r6(c).alias(c) for c in ("departure_time", "arrival_time", "travel_utility", "schedule_utility", "road_time")], F.abs(r6(F.col("in_bottleneck_time") + F.col("out_bottleneck_time"))).alias("waiting_time"),
        r6("route_free_flow_travel_time").alias("route_free_flow_travel_time"), "length", F.col("nb_edges").cast("double").alias("nb_edges"), r6("pre_exp_departure_time").alias("pre_exp_departure_time"), r6("exp_arrival_time").alias("exp_arrival_time"),
    )


@query(
    f"""WITH {_WORLD}, steps AS (SELECT l.agent_id, i, e.edge_id, l.departure_time, l.arrival_time, length / CASE WHEN l.agent_id % 2 = 1 THEN least(speed, 9e0) ELSE speed END + constant_travel_time AS spent
    FROM legs l JOIN (SELECT unnest([0, 1, 2, 3]) AS i) n ON i <= l.agent_id % 3 + 1 JOIN <EDGES> e ON e.edge_id = 2 * ((l.agent_id + i) % <NODES>) WHERE kind = 'Road')
  SELECT agent_id, edge_id, round(departure_time + sum(spent) OVER w - spent, 6) AS entry_time, round(departure_time + sum(spent) OVER w, 6) AS exit_time FROM steps WINDOW w AS (PARTITION BY agent_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""
)
def day_route_results(spark, sf_dir):
    """One row for each road taken."""
    rows = simulation.route_rows(_Day(spark, sf_dir).trips)
    return rows.select("agent_id", "edge_id", r6("entry_time").alias("entry_time"), r6("exit_time").alias("exit_time"))


_AGENTS = """results AS (SELECT c.agent_id, c.alt_id AS selected_alt_id, c.payoff AS expected_utility, c.departure AS departure_time, max(l.arrival_time) AS arrival_time, sum(l.arrival_time - l.departure_time) AS total_travel_time, c.value AS utility, c.value AS alt_expected_utility,
  CASE WHEN any_value(c.alt_id) < 2 THEN count(*) FILTER (l.kind = 'Road') END::BIGINT AS nb_road_trips, CASE WHEN any_value(c.alt_id) < 2 THEN count(*) FILTER (l.kind = 'Virtual') END::BIGINT AS nb_virtual_trips FROM chosen c LEFT JOIN legs l ON l.agent_id = c.agent_id GROUP BY ALL)"""


@query(
    f"""WITH {_WORLD}, {_AGENTS} SELECT agent_id, selected_alt_id, round(expected_utility, 6) AS expected_utility, departure_time, round(arrival_time, 6) AS arrival_time, round(total_travel_time, 6) AS total_travel_time,
  round(utility, 6) AS utility, round(alt_expected_utility, 6) AS alt_expected_utility, FALSE AS shifted_alt, NULL::DOUBLE AS departure_time_shift, nb_road_trips::DOUBLE AS nb_road_trips, nb_virtual_trips::DOUBLE AS nb_virtual_trips FROM results"""
)
def day_agent_results(spark, sf_dir):
    """One row for each agent."""
    a = _Day(spark, sf_dir).agents
    return a.select("agent_id", "selected_alt_id", *[r6(c).alias(c) for c in ("expected_utility", "departure_time", "arrival_time", "total_travel_time", "utility", "alt_expected_utility")], "shifted_alt", "departure_time_shift", *[F.col(c).cast("double").alias(c) for c in ("nb_road_trips", "nb_virtual_trips")])


def _four(value: str, name: str, where: str = "TRUE") -> str:
    return f"round(avg({value}) FILTER ({where}), 5) AS {name}_mean, round(stddev_pop({value}) FILTER ({where}), 5) AS {name}_std, round(min({value}) FILTER ({where}), 5) AS {name}_min, round(max({value}) FILTER ({where}), 5) AS {name}_max"


_ROAD, _VIRTUAL = "kind = 'Road'", "kind = 'Virtual'"
_GONE = "arrival_time - departure_time"
_FIGURES = ", ".join(
    [
        f"(SELECT count(*) FROM results WHERE departure_time IS NOT NULL)::BIGINT AS trip_alt_count, (SELECT count(*) FROM results WHERE departure_time IS NULL)::BIGINT AS no_trip_alt_count, count(*) FILTER ({_ROAD})::BIGINT AS road_trip_count, count(*) FILTER ({_VIRTUAL})::BIGINT AS virtual_trip_count",
        "(SELECT count(*) FROM results WHERE nb_road_trips > 0)::BIGINT AS nb_agents_at_least_one_road_trip, (SELECT count(*) FROM results WHERE nb_road_trips > 0 AND nb_virtual_trips = 0)::BIGINT AS nb_agents_all_road_trips",
        "(SELECT count(*) FROM results WHERE nb_virtual_trips > 0)::BIGINT AS nb_agents_at_least_one_virtual_trip, (SELECT count(*) FROM results WHERE nb_virtual_trips > 0 AND nb_road_trips = 0)::BIGINT AS nb_agents_all_virtual_trips",
        _four("departure_time", "road_trip_departure_time", _ROAD), _four("arrival_time", "road_trip_arrival_time", _ROAD), _four(_GONE, "road_trip_travel_time", _ROAD), _four("spent", "road_trip_road_time", _ROAD), _four("spent", "road_trip_route_free_flow_travel_time", _ROAD),
        _four("road_length", "road_trip_length", _ROAD), _four("nb_edges", "road_trip_edge_count", _ROAD), _four("travel_utility", "road_trip_utility", _ROAD), _four(_GONE, "road_trip_exp_travel_time", _ROAD),
        _four("departure_time", "virtual_trip_departure_time", _VIRTUAL), _four("arrival_time", "virtual_trip_arrival_time", _VIRTUAL), _four(_GONE, "virtual_trip_travel_time", _VIRTUAL), _four("travel_utility", "virtual_trip_utility", _VIRTUAL),
    ]
)
_OVER_AGENTS = ", ".join([_four("expected_utility", "surplus"), _four("departure_time", "alt_departure_time"), _four("arrival_time", "alt_arrival_time"), _four("total_travel_time", "alt_travel_time"), _four("utility", "alt_utility", "departure_time IS NOT NULL"), _four("alt_expected_utility", "alt_expected_utility", "departure_time IS NOT NULL"), _four("utility", "constant_utility", "departure_time IS NULL")])


@query(f"WITH {_WORLD}, {_AGENTS}, f AS (SELECT {_FIGURES} FROM legs), a AS (SELECT {_OVER_AGENTS} FROM results) SELECT * FROM f, a")
def day_iteration_results(spark, sf_dir):
    """The row of figures of one iteration."""
    day = _Day(spark, sf_dir)
    row = simulation.iteration_row(1, day.agents, day.trips, [day.simulated, day.weights, day.weights])
    counts = ["trip_alt_count", "no_trip_alt_count", "road_trip_count", "virtual_trip_count", *[f"nb_agents_{x}_{k}_trip{s}" for k in ("road", "virtual") for x, s in (("at_least_one", ""), ("all", "s"))]]
    fours = [f"road_trip_{c}" for c in ("departure_time", "arrival_time", "travel_time", "road_time", "route_free_flow_travel_time", "length", "edge_count", "utility", "exp_travel_time")]
    fours += [f"virtual_trip_{c}" for c in ("departure_time", "arrival_time", "travel_time", "utility")] + ["surplus", "alt_departure_time", "alt_arrival_time", "alt_travel_time", "alt_utility", "alt_expected_utility", "constant_utility"]
    return row.select(*[F.col(c).cast("bigint").alias(c) for c in counts], *[F.round(F.col(f"{c}_{k}").cast("double"), 5).alias(f"{c}_{k}") for c in fours for k in ("mean", "std", "min", "max")])


@query("SELECT 0e0 AS sim_road_network_cond_rmse, 0e0 AS exp_road_network_cond_rmse, 0e0 AS road_trip_exp_travel_time_diff_rmse, 0e0 AS alt_dep_time_rmse, 0e0 AS longest_detour, 0::BIGINT AS shifted")
def second_day(spark, sf_dir):
    """On empty roads a second day is as expected and as the first: no shift, no detour, no error of the conditions."""
    first = _Day(spark, sf_dir)
    day = _Day(spark, sf_dir, first)
    row = simulation.iteration_row(2, day.agents, day.trips, [day.simulated, first.simulated, day.weights])
    rest = day.trips.agg(F.max("length_diff").alias("longest_detour")).crossJoin(day.agents.agg(F.count_if("shifted_alt").alias("shifted")))  # one row each
    figures = row.select(*[F.abs(F.round(c, 5)).alias(c) for c in ("sim_road_network_cond_rmse", "exp_road_network_cond_rmse", "road_trip_exp_travel_time_diff_rmse", "alt_dep_time_rmse")])
    return figures.crossJoin(rest)


@query(
    f"""WITH {_WORLD}, mask AS (SELECT agent_id, row_number() OVER (ORDER BY h, agent_id) <= floor(0.25e0 * count(*) OVER ()) AS updates FROM (SELECT c_custkey AS agent_id, ('0x' || substr(md5('8:' || c_custkey::VARCHAR), 1, 15))::BIGINT AS h FROM customer) q)
  SELECT c.agent_id, CASE WHEN updates THEN alt_id ELSE 2 END AS alt_id, updates FROM chosen c JOIN mask m ON m.agent_id = c.agent_id"""
)
def partial_update(spark, sf_dir):
    """A fourth of the agents decides anew, the others keep what they chose (here: to stay)."""
    day = _Day(spark, sf_dir)
    mask = choice.update_mask(day.w.agents, "agent_id", 0.25, 7, 1)
    stayed = day.choices.withColumn("alt_id", F.lit(2).cast("bigint"))
    updated = mask.where("updates").select("agent_id")
    now = day.choices.join(updated, "agent_id", "left_semi").unionByName(stayed.join(updated, "agent_id", "left_anti"))
    return now.join(mask, "agent_id").select("agent_id", "alt_id", "updates")


@query(
    """SELECT v AS vehicle_id, edge_id, k * 3600e0 AS departure_time, round(length / CASE WHEN v = 1 THEN least(speed, 9e0) ELSE speed END + constant_travel_time, 6) AS travel_time
  FROM <EDGES> e CROSS JOIN (SELECT unnest([0::BIGINT, 1]) AS v) x CROSS JOIN (SELECT unnest(generate_series(0, 24)) AS k) y"""
)
def day_conditions(spark, sf_dir):
    """The simulated travel times of all vehicles and roads on the recording grid; without queues those of empty roads."""
    day = _Day(spark, sf_dir)
    got = simulation.sampled(day.w, day.simulated)
    return got.select("vehicle_id", "edge_id", "departure_time", r6("travel_time").alias("travel_time"))


@query(f"WITH {_WORLD} SELECT agent_id, trip_index, round(departure_time, 6) AS leg_departure, round(arrival_time, 6) AS leg_arrival FROM legs")
def expected_course(spark, sf_dir):
    """How the chosen trips are expected to go, before the day."""
    w = _world(spark, sf_dir)
    free = cut(simulation.free_flow(w), "free_flow")
    weights = simulation.initial_weights(spark, w, free)
    graphs = simulation._graphs(w, weights)
    got = simulation.expected_legs(w, simulation.decide(w, weights, graphs), weights, graphs)
    return got.select("agent_id", "trip_index", r6("leg_departure").alias("leg_departure"), r6("leg_arrival").alias("leg_arrival"))


# --- a crowded day -------------------------------------------------------------------------

#: No drive passes more than one crowded road: when it gets there is known, and the road's two gates are two queues.
_CROWDED = f"""{_WORLD}, expected AS (SELECT * FROM legs),
  steps AS (SELECT x.agent_id, i, e.edge_id, length / CASE WHEN x.agent_id % 2 = 1 THEN least(speed, 9e0) ELSE speed END + constant_travel_time AS spent, 1e0 / ({CROWDED_FLOW} * lanes) AS closing, x.departure_time
    FROM expected x JOIN (SELECT unnest([0, 1, 2, 3]) AS i) n ON i <= x.agent_id % 3 + 1 JOIN <EDGES> e ON e.edge_id = 2 * ((x.agent_id + i) % <NODES>) WHERE x.kind = 'Road'),
  reached AS (SELECT *, departure_time + sum(spent) OVER (PARTITION BY agent_id ORDER BY i ROWS UNBOUNDED PRECEDING) - spent AS reach FROM steps),
  at_entry AS (SELECT *, sum(closing) OVER w - closing AS served FROM reached WHERE edge_id % 10 = 0 WINDOW w AS (PARTITION BY edge_id ORDER BY reach, agent_id ROWS UNBOUNDED PRECEDING)),
  entered AS (SELECT *, served + max(reach - served) OVER (PARTITION BY edge_id ORDER BY reach, agent_id ROWS UNBOUNDED PRECEDING) AS entry FROM at_entry),
  at_exit AS (SELECT *, sum(closing) OVER (PARTITION BY edge_id ORDER BY entry + spent, agent_id ROWS UNBOUNDED PRECEDING) - closing AS served_out FROM entered),
  waits AS (SELECT agent_id, i AS at_step, entry - reach AS wait_in, served_out + max(entry + spent - served_out) OVER (PARTITION BY edge_id ORDER BY entry + spent, agent_id ROWS UNBOUNDED PRECEDING) - entry - spent AS wait_out FROM at_exit),
  real AS (SELECT x.*, CASE WHEN x.kind = 'Road' THEN coalesce(wait_in, 0e0) END AS wait_in, CASE WHEN x.kind = 'Road' THEN coalesce(wait_out, 0e0) END AS wait_out, coalesce(w.wait_in + w.wait_out, 0e0) AS late,
    x.arrival_time - x.departure_time AS exp_gone FROM expected x LEFT JOIN waits w ON w.agent_id = x.agent_id),
  moved AS (SELECT agent_id, trip_id, trip_index, kind, departure_time + CASE WHEN trip_index = 1 THEN late ELSE 0e0 END AS departure_time, arrival_time + late AS arrival_time, travel_utility - CASE WHEN kind = 'Road' THEN 0.002e0 * late ELSE 0e0 END AS travel_utility,
    spent, road_length, nb_edges, wait_in, wait_out, exp_gone, arrival_time AS exp_arrival FROM real)"""
_CROWDED_AGENTS = """results AS (SELECT c.agent_id, any_value(c.alt_id) AS selected_alt_id, any_value(c.payoff) AS expected_utility, any_value(c.departure) AS departure_time, max(m.arrival_time) AS arrival_time, sum(m.arrival_time - m.departure_time) AS total_travel_time,
  CASE WHEN any_value(c.alt_id) = 0 THEN sum(m.travel_utility) + any_value(d.bonus) - 0.0005e0 * sum(m.arrival_time - m.departure_time) - 0.0001e0 * greatest(40000e0 - max(m.arrival_time), 0e0) - 0.0002e0 * greatest(max(m.arrival_time) - 40000e0, 0e0) ELSE any_value(c.value) END AS utility,
  any_value(c.value) AS alt_expected_utility, CASE WHEN any_value(c.alt_id) < 2 THEN count(*) FILTER (m.kind = 'Road') END::BIGINT AS nb_road_trips, CASE WHEN any_value(c.alt_id) < 2 THEN count(*) FILTER (m.kind = 'Virtual') END::BIGINT AS nb_virtual_trips
  FROM chosen c LEFT JOIN moved m ON m.agent_id = c.agent_id LEFT JOIN drive d ON d.agent_id = c.agent_id GROUP BY c.agent_id)"""


@query(
    f"""WITH {_CROWDED} SELECT agent_id, trip_id, trip_index, round(departure_time, 6) AS departure_time, round(arrival_time, 6) AS arrival_time, round(travel_utility, 6) AS travel_utility, round(CASE WHEN kind = 'Road' THEN spent ELSE 0e0 END, 6) AS road_time,
  round(coalesce(wait_in, 0e0), 6) AS in_bottleneck_time, round(coalesce(wait_out, 0e0), 6) AS out_bottleneck_time, round(CASE WHEN kind = 'Road' THEN spent END, 6) AS route_free_flow_travel_time, round(CASE WHEN kind = 'Road' THEN exp_arrival END, 6) AS pre_exp_arrival_time FROM moved"""
)
def crowded_trip_results(spark, sf_dir):
    """Legs of a day with queues at the gates of every fifth road."""
    t = _Day(spark, sf_dir, crowded=True).trips
    waits = [F.abs(F.round(F.coalesce(c, F.lit(0.0)), 6)).alias(c) for c in ("in_bottleneck_time", "out_bottleneck_time")]
    return t.select("agent_id", "trip_id", "trip_index", *[r6(c).alias(c) for c in ("departure_time", "arrival_time", "travel_utility", "road_time")], *waits, r6("route_free_flow_travel_time").alias("route_free_flow_travel_time"), r6("pre_exp_arrival_time").alias("pre_exp_arrival_time"))


@query(
    f"""WITH {_CROWDED} SELECT r.agent_id, edge_id, round(reach + CASE WHEN i = at_step THEN wait_in WHEN i > at_step THEN wait_in + wait_out ELSE 0e0 END, 6) AS entry_time,
  round(coalesce(lead(reach + CASE WHEN i = at_step THEN wait_in WHEN i > at_step THEN wait_in + wait_out ELSE 0e0 END) OVER (PARTITION BY r.agent_id ORDER BY i), reach + spent + coalesce(wait_in + wait_out, 0e0)), 6) AS exit_time
  FROM reached r LEFT JOIN waits w ON w.agent_id = r.agent_id"""
)
def crowded_route_results(spark, sf_dir):
    """Roads taken that day, entered after the wait at their gate."""
    rows = simulation.route_rows(_Day(spark, sf_dir, crowded=True).trips)
    return rows.select("agent_id", "edge_id", r6("entry_time").alias("entry_time"), r6("exit_time").alias("exit_time"))


@query(
    f"""WITH {_CROWDED}, {_CROWDED_AGENTS} SELECT agent_id, selected_alt_id, round(expected_utility, 6) AS expected_utility, departure_time, round(arrival_time, 6) AS arrival_time, round(total_travel_time, 6) AS total_travel_time,
  round(utility, 6) AS utility, round(alt_expected_utility, 6) AS alt_expected_utility FROM results"""
)
def crowded_agent_results(spark, sf_dir):
    """What the queues make of everybody's day: realized against expected utility."""
    a = _Day(spark, sf_dir, crowded=True).agents
    return a.select("agent_id", "selected_alt_id", *[r6(c).alias(c) for c in ("expected_utility", "departure_time", "arrival_time", "total_travel_time", "utility", "alt_expected_utility")])


_CROWDED_FIGURES = _FIGURES.replace(_four(_GONE, "road_trip_exp_travel_time", _ROAD), _four("exp_gone", "road_trip_exp_travel_time", _ROAD)) + ", " + ", ".join(
    [_four("wait_in", "road_trip_in_bottleneck_time", _ROAD), _four("wait_out", "road_trip_out_bottleneck_time", _ROAD), _four(f"({_GONE} - spent) / spent", "road_trip_route_congestion", _ROAD), f"round(sqrt(avg(({_GONE} - exp_gone) ** 2) FILTER ({_ROAD})), 5) AS road_trip_exp_travel_time_diff_rmse"]
)


@query(f"WITH {_CROWDED}, {_CROWDED_AGENTS}, f AS (SELECT {_CROWDED_FIGURES} FROM moved), a AS (SELECT {_OVER_AGENTS} FROM results) SELECT * FROM f, a")
def crowded_iteration_results(spark, sf_dir):
    """The row of figures of that day, waits, congestion and errors of the expectation among them."""
    day = _Day(spark, sf_dir, crowded=True)
    row = simulation.iteration_row(1, day.agents, day.trips, [day.simulated, day.weights, day.weights])
    counts = ["trip_alt_count", "no_trip_alt_count", "road_trip_count", "virtual_trip_count", *[f"nb_agents_{x}_{k}_trip{s}" for k in ("road", "virtual") for x, s in (("at_least_one", ""), ("all", "s"))]]
    fours = [f"road_trip_{c}" for c in ("departure_time", "arrival_time", "travel_time", "road_time", "route_free_flow_travel_time", "length", "edge_count", "utility", "exp_travel_time", "in_bottleneck_time", "out_bottleneck_time", "route_congestion")]
    fours += [f"virtual_trip_{c}" for c in ("departure_time", "arrival_time", "travel_time", "utility")] + ["surplus", "alt_departure_time", "alt_arrival_time", "alt_travel_time", "alt_utility", "alt_expected_utility", "constant_utility"]
    rounded = [F.abs(F.round(F.col(f"{c}_{k}").cast("double"), 5)).alias(f"{c}_{k}") if "bottleneck" in c or "congestion" in c else F.round(F.col(f"{c}_{k}").cast("double"), 5).alias(f"{c}_{k}") for c in fours for k in ("mean", "std", "min", "max")]
    return row.select(*[F.col(c).cast("bigint").alias(c) for c in counts], *rounded, F.round("road_trip_exp_travel_time_diff_rmse", 5).alias("road_trip_exp_travel_time_diff_rmse"))


#: Grid of the departures and length of each customer's period.
_STEP, _LONG = 1800.0, 36000.0
#: A customer's best departure lies on the grid; early arrivals cost ``b`` and late ones ``g`` a second.
_ANY_TIME = f"""WITH own AS (SELECT {_KEY} AS k, 3600e0 * ({_KEY} % 4) AS lo, 600e0 + {_KEY} % 900 AS spent, {_STEP}e0 * (3 + {_KEY} % 11) AS peak, 1e-4 * (1 + {_KEY} % 3) AS b, 1e-4 * (2 + {_KEY} % 5) AS g,
    (({_KEY} * 7919) % 997 + 1) / 1000e0 AS u, 1e0 + {_KEY} % 2 AS mu FROM customer),
  sums AS (SELECT *, mu / b * (1 - exp(-b * peak / mu)) AS early, mu / g * (1 - exp(-g * ({_LONG}e0 - peak) / mu)) AS late FROM own)
  SELECT k AS agent_id, round(lo + peak + CASE WHEN u * (early + late) <= early THEN mu / b * ln(u * (early + late) * b / mu + exp(-b * peak / mu))
    ELSE -mu / g * ln(1 - (u * (early + late) - early) * g / mu) END, 3) AS departure, round(0.5e0 - 0.0015e0 * spent + mu * (ln(early + late) + {choice.EULER}e0), 6) AS expected_utility FROM sums"""


@query(_ANY_TIME)
def day_at_any_time(spark, sf_dir):
    """Departures drawn from a continuous logit over a utility that rises to the best arrival and falls behind it."""
    key, none = F.col(_KEY), F.lit(None)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(_KEY)
    lo, spent = 3600.0 * (key % 4), (600 + key % 900).cast("double")
    alternatives = c.select(
        key.alias("agent_id"), F.lit(0).cast("bigint").alias("alt_id"), F.lit("Continuous").alias("dt_choice.type"), F.array(lo, lo + _LONG).alias("dt_choice.period"), F.lit("Logit").alias("dt_choice.model.type"),
        (((key * 7919) % 997 + 1) / 1000.0).alias("dt_choice.model.u"), (1.0 + key % 2).alias("dt_choice.model.mu"), F.lit(0.5).alias("constant_utility"), F.lit("Linear").alias("destination_utility.type"),
        (lo + _STEP * (3 + key % 11) + spent).alias("destination_utility.tstar"), (1e-4 * (1 + key % 3)).alias("destination_utility.beta"), (1e-4 * (2 + key % 5)).alias("destination_utility.gamma"),
    )
    trips = c.select(
        key.alias("agent_id"), F.lit(0).cast("bigint").alias("alt_id"), F.lit(0).cast("bigint").alias("trip_id"), F.lit("Virtual").alias("class.type"), spent.alias("class.travel_time"), F.lit(-0.0015).alias("travel_utility.one"),
        *[none.cast("bigint").alias(f"class.{n}") for n in ("origin", "destination", "vehicle")], none.cast("array<bigint>").alias("class.route"),
    )
    given = {"agents": c.select(key.alias("agent_id")), "alternatives": alternatives, "trips": trips}
    placed = {n: t.withColumn("row_index", F.struct(F.lit("").alias("file"), F.col("agent_id").cast("bigint").alias("row"))) for n, t in given.items()}
    p = SimulationParameters({}, PERIOD, departure_time_interval=_STEP)
    w = simulation.world(spark, p, {name: cut(tables.read(table, name), name) for name, table in placed.items()})
    return simulation.decide(w, None, {}).select("agent_id", F.round("departure", 3).alias("departure"), r6("expected_utility").alias("expected_utility"))
