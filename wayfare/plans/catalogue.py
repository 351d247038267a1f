"""Queries of the engine by name, and their SQL.

Every query applies operators of this package to the network of ``derived``; the SQL says the same
from the raw tables.  Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import pwl, scalars
from wayfare.operators import choice, learning, network, summary
from wayfare.plans import derived as d
from wayfare.streaming import gates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; its SQL may name derived tables in angle brackets."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for name in re.findall(r"<([A-Z_]+)>", text):
                text = text.replace(f"<{name}>", getattr(d, name))
            ORACLES[f.__name__] = d.sql(text)
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _functions(spark, sf_dir, *values: str) -> DataFrame:
    """One struct per edge for each value column of the grid."""
    grid = d.frame(spark, sf_dir, d.GRID)
    out = None
    for v in values:
        built = pwl.build(grid, ["edge_id"], "x", v, 0.0).withColumnRenamed("ttf", v)
        out = built if out is None else out.join(built, "edge_id")
    return out


def _long(df: DataFrame, f: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(f["points"]).alias("k", "value")).select(*keys, F.col("k").cast("bigint").alias("k"), r6("value").alias("value"))


# --- functions of time ---------------------------------------------------------------------


@query("SELECT edge_id, count(*)::BIGINT AS n_points, min(x) AS start_x, 3600e0 AS interval_x, min(y) AS y_min, max(y) AS y_max, sum(y) AS y_sum FROM <GRID> g GROUP BY edge_id")
def ttf_build(spark, sf_dir):
    f = F.col("y")
    built = _functions(spark, sf_dir, "y")
    total = F.aggregate(f["points"], F.lit(0.0), lambda a, y: a + y)
    return built.select("edge_id", pwl.complexity(f).cast("bigint").alias("n_points"), f["start_x"].alias("start_x"), f["interval_x"].alias("interval_x"), pwl.least(f).alias("y_min"), pwl.greatest(f).alias("y_max"), total.alias("y_sum"))


@query(
    """SELECT request_id, r.edge_id, t, round(a.y + (t - a.x) / 3600e0 * (b.y - a.y), 6) AS travel_time FROM <REQUESTS> r
  JOIN <GRID> a ON a.edge_id = r.edge_id AND a.k = floor(t / 3600e0)::BIGINT JOIN <GRID> b ON b.edge_id = r.edge_id AND b.k = a.k + 1"""
)
def ttf_eval(spark, sf_dir):
    requests = d.frame(spark, sf_dir, d.REQUESTS)
    return requests.join(_functions(spark, sf_dir, "y"), "edge_id").select("request_id", "edge_id", "t", r6(pwl.evaluate(F.col("y"), F.col("t"))).alias("travel_time"))


_PAIR = """WITH g AS (SELECT * FROM <GRID> q) """
_AT = "(a.{y} + ({t} - a.x) / 3600e0 * (coalesce(b.{y}, a.{y}) - a.{y}))"


@query(
    _PAIR
    + """SELECT f.edge_id, f.k, round(f.y + CASE WHEN f.x + f.y >= 86400e0 THEN z.y2 ELSE a.y2 + (f.x + f.y - a.x) / 3600e0 * (b.y2 - a.y2) END, 6) AS value
  FROM g f JOIN g z ON z.edge_id = f.edge_id AND z.k = 24 LEFT JOIN g a ON a.edge_id = f.edge_id AND a.k = floor((f.x + f.y) / 3600e0)::BIGINT LEFT JOIN g b ON b.edge_id = f.edge_id AND b.k = a.k + 1"""
)
def pwl_link(spark, sf_dir):
    return _long(_functions(spark, sf_dir, "y", "y2"), pwl.link(F.col("y"), F.col("y2")), "edge_id")


@query("SELECT edge_id, k, least(y, y2) AS value FROM <GRID> g")
def pwl_merge(spark, sf_dir):
    return _long(_functions(spark, sf_dir, "y", "y2"), pwl.merge(F.col("y"), F.col("y2")), "edge_id")


@query("SELECT edge_id, k, round(y * 2e0 - y2, 6) AS value FROM <GRID> g")
def pwl_apply(spark, sf_dir):
    return _long(_functions(spark, sf_dir, "y", "y2"), pwl.combine(F.col("y"), F.col("y2"), lambda a, b: a * 2 - b), "edge_id")


@query(
    """SELECT edge_id, round(sum(d0 * d0 + d0 * d1 + d1 * d1) / 3e0 / 24e0, 6) AS squared_difference
  FROM (SELECT edge_id, y - y2 AS d0, lead(y - y2) OVER (PARTITION BY edge_id ORDER BY k) AS d1 FROM <GRID> g) s WHERE d1 IS NOT NULL GROUP BY edge_id"""
)
def pwl_sqdiff(spark, sf_dir):
    return _functions(spark, sf_dir, "y", "y2").select("edge_id", r6(pwl.squared_difference(F.col("y"), F.col("y2"))).alias("squared_difference"))


_FIFO = "SELECT edge_id, k, round(max(x + steep - k * 1e0) OVER (PARTITION BY edge_id ORDER BY k) + k * 1e0 - x, 6) AS value FROM <GRID> g"


@query(_FIFO)
def pwl_fifo(spark, sf_dir):
    return _long(_functions(spark, sf_dir, "steep"), pwl.ensure_fifo(F.col("steep"), 1.0), "edge_id")


@query(_FIFO)
def pwl_fifo_rows(spark, sf_dir):
    rows = d.frame(spark, sf_dir, d.GRID).select("edge_id", "k", "x", "steep")
    return pwl.ensure_fifo_rows(rows, ["edge_id"], "x", "steep", 1.0).select("edge_id", "k", r6("steep").alias("value"))


@query(
    """WITH s AS (SELECT edge_id, k, x, y - y2 AS d0, lead(y - y2) OVER (PARTITION BY edge_id ORDER BY k) AS d1 FROM <GRID> g),
  c AS (SELECT edge_id, -1 AS k, x, sign(d0)::DOUBLE AS sign FROM s WHERE k = 0
    UNION ALL SELECT edge_id, k, x + 3600e0 * d0 / (d0 - d1), sign(d1)::DOUBLE FROM s WHERE d0 * d1 < 0
    UNION ALL SELECT edge_id, k, x, sign(d1)::DOUBLE FROM s WHERE d0 = 0 AND d1 <> 0
    UNION ALL SELECT edge_id, k, x + 3600e0, 0e0 FROM s WHERE d1 = 0 AND d0 <> 0)
  SELECT edge_id, round(x, 6) AS x, sign FROM (SELECT *, lag(sign) OVER (PARTITION BY edge_id ORDER BY k) AS before FROM c) z WHERE before IS NULL OR before <> sign"""
)
def pwl_crossings(spark, sf_dir):
    both = _functions(spark, sf_dir, "y", "y2")
    listed = both.select("edge_id", F.explode(pwl.relative_position(F.col("y"), F.col("y2"))).alias("c"))
    return listed.select("edge_id", r6("c.x").alias("x"), F.col("c.sign").alias("sign"))


@query("SELECT edge_id, k, y AS travel_time, x AS departure_time FROM <GRID> g WHERE k % 2 = 0")
def edge_ttfs_sampled(spark, sf_dir):
    """The sink of network conditions: every function on the period's grid."""
    rows = _functions(spark, sf_dir, "y").select("edge_id", F.posexplode(pwl.sample(F.col("y"), 0.0, 86400.0, 7200.0)).alias("i", "p"))
    return rows.select("edge_id", (F.col("i") * 2).cast("bigint").alias("k"), "p.travel_time", "p.departure_time")


# --- observation grids and gates -----------------------------------------------------------


def _binning(step: str) -> str:
    return f"""WITH o AS (SELECT *, floor(t / {step})::BIGINT AS low, t / {step} - floor(t / {step}) AS share FROM <OBSERVED> q),
  s AS (SELECT edge_id, low AS bin, 1e0 - share AS w, y FROM o UNION ALL SELECT edge_id, low + 1, share, y FROM o),
  m AS (SELECT edge_id, bin, sum(w * y) / sum(w) AS y FROM s WHERE w > 0 GROUP BY edge_id, bin),
  grid AS (SELECT edge_id, unnest(generate_series(0, (86400e0 / {step})::BIGINT)) AS bin FROM (SELECT DISTINCT edge_id FROM o) e)
  SELECT grid.edge_id, grid.bin::BIGINT AS bin, grid.bin * {step} AS x, round(coalesce(m.y, 0e0), 6) AS y FROM grid LEFT JOIN m ON m.edge_id = grid.edge_id AND m.bin = grid.bin"""


def _observe(spark, sf_dir, step):
    seen = gates.observe(d.frame(spark, sf_dir, d.OBSERVED), ["edge_id"], "t", "y", 0.0, 86400.0, step)
    return seen.select("edge_id", F.col("bin").cast("bigint").alias("bin"), "x", r6("y").alias("y"))


@query(_binning("3600e0"))
def wait_binning(spark, sf_dir):
    return _observe(spark, sf_dir, 3600.0)


@query(_binning("7200e0"))
def length_binning(spark, sf_dir):
    return _observe(spark, sf_dir, 7200.0)


@query(
    """WITH a AS (SELECT request_id, r.edge_id, t, 1e0 / (flow * lanes) AS s FROM <REQUESTS> r JOIN <EDGES> e ON e.edge_id = r.edge_id),
  b AS (SELECT *, sum(s) OVER w - s AS before FROM a WINDOW w AS (PARTITION BY edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING))
  SELECT request_id, edge_id, t, round(before + max(t - before) OVER (PARTITION BY edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING), 6) AS exit_time FROM b"""
)
def fifo_gate(spark, sf_dir):
    edges = d.frame(spark, sf_dir, d.EDGES)
    arrivals = d.frame(spark, sf_dir, d.REQUESTS).withColumn("position", F.col("request_id")).join(edges, "edge_id")
    service = scalars.closing_time(F.lit(1.0), F.col("flow"), F.col("lanes"))
    return gates.fifo_gate(arrivals, "edge_id", "t", service).select("request_id", "edge_id", "t", r6("exit_time").alias("exit_time"))


def _layers() -> str:
    """Layer by layer: a road's gate lets vehicles in one by one, in the order in which those before let them go."""
    steps = ["l0 AS (SELECT r.trip_id, r.edge_id, departure + r.trip_id % 8191 / 8191e0 AS reach FROM <LAYER_ROUTES> r JOIN <TRIPS> t ON t.trip_id = r.trip_id WHERE position = 0)"]
    for k in range(d.LAYERS):
        steps.append(
            f"""e{k} AS (SELECT *, before + max(reach - before) OVER (PARTITION BY edge_id ORDER BY reach, trip_id ROWS UNBOUNDED PRECEDING) AS entry
    FROM (SELECT l.*, length / speed AS spent, coalesce(1e0 / (flow * lanes), 0e0) AS closing,
      sum(coalesce(1e0 / (flow * lanes), 0e0)) OVER (PARTITION BY l.edge_id ORDER BY reach, trip_id ROWS UNBOUNDED PRECEDING) - coalesce(1e0 / (flow * lanes), 0e0) AS before FROM l{k} l JOIN <LAYER_EDGES> e ON e.edge_id = l.edge_id) q)"""
        )
        if k + 1 < d.LAYERS:
            steps.append(f"l{k + 1} AS (SELECT e.trip_id, r.edge_id, entry + spent AS reach FROM e{k} e JOIN <LAYER_ROUTES> r ON r.trip_id = e.trip_id AND r.position = {k + 1})")
    union = " UNION ALL ".join(f"SELECT trip_id, reach, entry, spent FROM e{k}" for k in range(d.LAYERS))
    return f"WITH {', '.join(steps)} SELECT trip_id, round(max(entry + spent), 4) AS arrival_time, round(sum(spent), 4) AS road_time, round(sum(entry - reach), 4) AS in_bottleneck_time, 0e0 AS out_bottleneck_time FROM ({union}) a GROUP BY trip_id"


@query(_layers())
def supply_simulation(spark, sf_dir):
    """Trips with given routes over roads with bottlenecks, all of them joined to one another."""
    from wayfare.plans.within_day import simulate_routes

    # a part of a second by trip, so that no two come to a gate at one time
    departures = d.frame(spark, sf_dir, d.TRIPS).select("trip_id", (F.col("departure") + F.col("trip_id") % 8191 / 8191).alias("departure"))
    got = simulate_routes(departures, d.frame(spark, sf_dir, d.LAYER_ROUTES), d.frame(spark, sf_dir, d.LAYER_EDGES))
    return got.select("trip_id", *[F.abs(F.round(c, 4)).alias(c) for c in got.columns[1:]])


_VARYING = """WITH RECURSIVE a AS (SELECT request_id, r.edge_id, t, 0.002e0 * flow * lanes AS rate, row_number() OVER (PARTITION BY r.edge_id ORDER BY t, request_id) AS rn FROM <REQUESTS> r JOIN <EDGES> e ON e.edge_id = r.edge_id),
  p AS (SELECT request_id, edge_id, rn, rate, t, t AS e FROM a WHERE rn = 1
    UNION ALL SELECT a.request_id, a.edge_id, a.rn, a.rate, a.t, greatest(a.t, p.e + 1e0 / (p.rate * CASE WHEN p.e < 28800e0 THEN 1e0 WHEN p.e < 61200e0 THEN 0.5e0 ELSE 3e0 END)) FROM p JOIN a ON a.edge_id = p.edge_id AND a.rn = p.rn + 1)
  SELECT request_id, edge_id, t, round(e, 6) AS exit_time FROM p"""


@query(_VARYING)
def fifo_gate_varying(spark, sf_dir):
    """Gates of a flow that halves at eight and is three times as much from five in the afternoon on."""
    arrivals = d.frame(spark, sf_dir, d.REQUESTS).withColumn("position", F.col("request_id")).join(d.frame(spark, sf_dir, d.EDGES), "edge_id")
    closings = F.transform(F.array(F.lit(1.0), F.lit(0.5), F.lit(3.0)), lambda share: 1.0 / (0.002 * F.col("flow") * F.col("lanes") * share))
    shaped = arrivals.withColumn("times", F.array(F.lit(0.0), F.lit(28800.0), F.lit(61200.0))).withColumn("closings", closings)
    return gates.fifo_gate_varying(shaped, "edge_id", "t", "times", "closings", 3).select("request_id", "edge_id", "t", r6("exit_time").alias("exit_time"))


#: Length of a vehicle on the dense roads, their capacity, and the densities and speed of the three regimes.
_DENSE = {"headway": 40.0, "capacity": 0.02, "low": 0.05, "jam": 0.4, "slow": 2.0, "beta": 1.0}


def _dense_layers() -> str:
    """Layer by layer, on each road one vehicle after the other, with the list of the exits of those before it."""
    c = _DENSE
    steps = ["l0 AS (SELECT r.trip_id, r.edge_id, departure / 8e0 + r.trip_id % 8191 / 8191e0 AS reach FROM <LAYER_ROUTES> r JOIN <TRIPS> t ON t.trip_id = r.trip_id WHERE position = 0)"]
    for k in range(d.DENSE_LAYERS):
        steps.append(f"o{k} AS (SELECT l.*, length, speed, length * lanes AS room, kind, row_number() OVER (PARTITION BY l.edge_id ORDER BY reach, trip_id) AS rn FROM l{k} l JOIN <DENSE_EDGES> e ON e.edge_id = l.edge_id)")
        occupied = f"{c['headway']}e0 * len(list_filter(exits, lambda x: x > o.reach))"
        share = f"(({occupied}) / room - {c['low']}e0) / {c['jam'] - c['low']}e0"
        speed = f"""CASE WHEN kind = 'Bottleneck' THEN CASE WHEN {occupied} <= {c['capacity']}e0 * room / speed THEN speed ELSE room / ({occupied}) * {c['capacity']}e0 END
      WHEN kind = 'ThreeRegimes' THEN CASE WHEN ({occupied}) / room >= {c['jam']}e0 THEN least({c['slow']}e0, speed) WHEN ({occupied}) / room > {c['low']}e0 THEN least(speed * (1e0 - {share}) + {c['slow']}e0 * ({share}), speed) ELSE speed END ELSE speed END"""
        steps.append(f"""p{k} AS (SELECT edge_id, 0::BIGINT AS rn, 0::BIGINT AS trip_id, 0e0 AS reach, 0e0 AS leaves, []::DOUBLE[] AS exits FROM (SELECT DISTINCT edge_id FROM o{k}) q
    UNION ALL SELECT edge_id, rn, trip_id, reach, reach + length / v, list_filter(exits, lambda x: x > reach) || [reach + length / v] FROM (SELECT o.edge_id, o.rn, o.trip_id, o.reach, length, exits, {speed} AS v FROM p{k} p JOIN o{k} o ON o.edge_id = p.edge_id AND o.rn = p.rn + 1) n)""")
        if k + 1 < d.DENSE_LAYERS:
            steps.append(f"l{k + 1} AS (SELECT p.trip_id, r.edge_id, leaves AS reach FROM p{k} p JOIN <LAYER_ROUTES> r ON r.trip_id = p.trip_id AND r.position = {k + 1} WHERE p.rn > 0)")
    union = " UNION ALL ".join(f"SELECT trip_id, edge_id, reach, leaves FROM p{k} WHERE rn > 0" for k in range(d.DENSE_LAYERS))
    return f"WITH RECURSIVE {', '.join(steps)} SELECT trip_id, edge_id, round(reach, 5) AS entry_time, round(leaves, 5) AS exit_time FROM ({union}) a"


@query(_dense_layers())
def dense_roads(spark, sf_dir):
    """Trips over roads whose speed falls with the vehicles on them: bottlenecks, three regimes, and free ones."""
    from wayfare.plans.within_day import dense_network

    departures = d.frame(spark, sf_dir, d.TRIPS).select("trip_id", (F.col("departure") / 8 + F.col("trip_id") % 8191 / 8191).alias("departure"))
    rules = {"capacity": "capacity", "min_density": "low", "jam_density": "jam", "jam_speed": "slow", "beta": "beta"}
    edges = d.frame(spark, sf_dir, d.DENSE_EDGES).withColumnRenamed("kind", "speed_density_type").withColumns({f"speed_density_{c}": F.lit(_DENSE[k]) for c, k in rules.items()})
    # a layer's roads are those of its position
    routes = d.frame(spark, sf_dir, d.LAYER_ROUTES).where(F.col("position") < d.DENSE_LAYERS)
    got = dense_network(departures, routes, edges, headway=_DENSE["headway"])
    return got.select("trip_id", "edge_id", F.round("entry_time", 5).alias("entry_time"), F.round("exit_time", 5).alias("exit_time"))


#: Closings of the three roads of a corridor in multiples of the inverse flow.
_CORRIDOR = (150.0, 200.0, 250.0)


def _corridors() -> str:
    """Stage by stage: an entry gate and the exit gate before it that waits for it serve like one gate of the longer closing."""
    steps = ["e0 AS (SELECT *, b + max(t - b) OVER (PARTITION BY edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING) AS entry0 FROM (SELECT *, sum(c0) OVER w - c0 AS b FROM a WINDOW w AS (PARTITION BY edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING)) q)"]
    for k in (1, 2, 3):
        closing = f"greatest(c{k - 1}, c{k})" if k < 3 else "c2"
        at = f"entry{k - 1} + spent"
        served = f"SELECT *, sum({closing}) OVER w - {closing} AS b{k} FROM e{k - 1} WINDOW w AS (PARTITION BY edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING)"
        steps.append(f"e{k} AS (SELECT *, greatest({at}, coalesce(lag(entry{k}) OVER (PARTITION BY edge_id ORDER BY t, request_id) + c{k - 1}, {at})) AS exit{k - 1} FROM (SELECT *, b{k} + max({at} - b{k}) OVER (PARTITION BY edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING) AS entry{k} FROM ({served}) q) r)")
    rows = " UNION ALL ".join(f"SELECT request_id, {k}::BIGINT AS step, edge_id, round({'t' if k == 0 else f'exit{k - 1}'}, 5) AS reach_time, round(entry{k}, 5) AS entry_time, round(entry{k} + spent, 5) AS at_exit, round(exit{k}, 5) AS exit_time FROM e3" for k in range(3))
    return f"""WITH a AS (SELECT request_id, r.edge_id, t, length / speed AS spent, {_CORRIDOR[0]}e0 / (flow * lanes) AS c0, {_CORRIDOR[1]}e0 / (flow * lanes) AS c1, {_CORRIDOR[2]}e0 / (flow * lanes) AS c2 FROM <REQUESTS> r JOIN <EDGES> e ON e.edge_id = r.edge_id), {', '.join(steps)} {rows}"""


@query(_corridors())
def ordered_exits(spark, sf_dir):
    """Three roads one after the other at each road of the network, none to be overtaken at an exit: who waits to enter the next one keeps those behind on theirs."""
    from wayfare.plans.within_day import queue_steps

    trips = d.frame(spark, sf_dir, d.REQUESTS).join(d.frame(spark, sf_dir, d.EDGES), "edge_id")
    roads = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("position"), F.lit(c).alias("share")) for k, c in enumerate(_CORRIDOR)])).alias("road")
    rows = trips.select("request_id", "edge_id", "t", "length", "speed", "flow", "lanes", roads)
    rows = rows.select(
        F.col("request_id").alias("trip_id"), "road.position", (F.col("edge_id") * 3 + F.col("road.position")).alias("edge_id"), F.col("t").alias("departure"), F.lit(0.0).alias("gap"), (F.col("length") / F.col("speed")).alias("spent"),
        (F.col("road.share") / (F.col("flow") * F.col("lanes"))).alias("closing"), F.lit(True).alias("ordered"),
    )
    got = queue_steps(rows)
    return got.select(F.col("trip_id").alias("request_id"), F.col("position").alias("step"), F.expr("edge_id div 3").alias("edge_id"), *[F.round(c, 5).alias(c) for c in ("reach_time", "entry_time", "at_exit", "exit_time")])


@query(
    """WITH o AS (SELECT user_id % 100 AS user_group, epoch_us(ts) / 3600000000 AS place, value AS y FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
  s AS (SELECT user_group, floor(place)::BIGINT AS bin, 1e0 - (place - floor(place)) AS w, y FROM o UNION ALL SELECT user_group, floor(place)::BIGINT + 1, place - floor(place), y FROM o),
  m AS (SELECT user_group, bin, sum(w * y) / sum(w) AS y FROM s WHERE w > 0 GROUP BY user_group, bin)
  SELECT user_group, bin * 3600 AS point, round(y, 6) AS y FROM m WHERE (bin + 1) * 3600 <= (SELECT epoch_us(max(ts)) / 1e6 FROM events) - 86400"""
)
def observed_points(spark, sf_dir):
    """The grid of observations as a stream takes them: each point once, when the watermark has passed it."""
    from wayfare.sources.shared import shared_dir
    from wayfare.streaming import observations

    path, folder = f"{sf_dir.rstrip('/')}/events.parquet", f"{shared_dir(spark)}/observed-{uuid.uuid4().hex}"
    # the last letter in brackets makes the path a pattern, which may name a file as well as a folder
    records = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").where("user_id IS NOT NULL")
    records = records.select((F.col("user_id") % 100).alias("user_group"), F.col("ts").cast("timestamp").alias("ts"), "value")
    seen = observations.observe_stream(records, ["user_group"], "ts", "value", "1 hour", "1 day")
    seen.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/points").awaitTermination()
    found = spark.read.schema(seen.schema).parquet(f"{folder}/points")
    return found.select("user_group", F.unix_seconds("point").alias("point"), F.round("y", 6).alias("y"))


# --- scalar formulas -----------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS trip_id, round(3e0 + (-0.002e0 - 0.001e0) * t + 1e-6 * t * t - 1e-11 * t * t * t, 6) AS utility
  FROM (SELECT o_orderkey, CAST((o_orderkey * 13) % 7200 AS DOUBLE) AS t FROM orders) q"""
)
def travel_utility(spark, sf_dir):
    t = ((F.col("o_orderkey") * 13) % 7200).cast("double")
    c = [F.lit(x) for x in (3.0, -0.002, 1e-6, -1e-11)]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("trip_id"), r6(scalars.travel_utility(t, *c, F.lit(None), alpha=F.lit(0.001))).alias("utility"))


@query(
    """SELECT trip_id, departure, round(CASE WHEN kind = 1 THEN 0e0 WHEN departure < 30000e0 - 300e0 THEN -0.003e0 * (29700e0 - departure) WHEN departure > 30300e0 THEN -0.008e0 * (departure - 30300e0) ELSE 0e0 END, 6) AS utility
  FROM (SELECT trip_id, departure, dt_kind AS kind FROM <TRIPS> t) q"""
)
def schedule_utility(spark, sf_dir):
    kind = F.when(F.col("dt_kind") == 1, F.lit(None).cast("string")).otherwise("Linear")
    value = scalars.schedule_utility(F.col("departure"), kind, F.lit(30000.0), F.lit(0.003), F.lit(0.008), F.lit(600.0))
    return d.frame(spark, sf_dir, d.TRIPS).select("trip_id", "departure", r6(value).alias("utility"))


@query(
    """WITH legs AS (SELECT r.trip_id, departure, position, spent,
    departure + 5e0 + sum(spent) OVER w + 30e0 * (row_number() OVER w - 1) AS arrival FROM <ROUTES> r JOIN <TRIPS> t ON t.trip_id = r.trip_id WINDOW w AS (PARTITION BY r.trip_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
  sums AS (SELECT trip_id, any_value(departure) AS departure, sum(1e0 - 0.001e0 * spent - 0.0001e0 * greatest(arrival - 40000e0, 0e0)) AS u, sum(spent) AS travel, max(arrival) + 30e0 AS t FROM legs GROUP BY trip_id)
  SELECT trip_id, round(u - 1e-7 * travel * travel - 0.0002e0 * greatest(30000e0 - t, 0e0) - 0.0003e0 * greatest(t - 30000e0, 0e0), 6) AS utility FROM sums"""
)
def trip_utility(spark, sf_dir):
    zero, none = F.lit(0.0), F.lit(None)
    leg = F.struct(
        F.col("position"),
        pwl.constant(F.col("spent")).alias("ttf"),
        F.lit(30.0).alias("stopping"),
        F.lit(1.0).alias("constant"),
        F.lit(-0.001).alias("one"),
        zero.alias("two"),
        zero.alias("three"),
        zero.alias("four"),
        zero.alias("alpha"),
        F.lit("Linear").alias("kind"),
        F.lit(40000.0).alias("tstar"),
        zero.alias("beta"),
        F.lit(0.0001).alias("gamma"),
        zero.alias("delta"),
    )
    legs = d.frame(spark, sf_dir, d.ROUTES).groupBy("trip_id").agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    side = {"kind": F.lit("Linear"), "tstar": F.lit(30000.0), "beta": F.lit(0.0002), "gamma": F.lit(0.0003), "delta": zero}
    nothing = {k: none.cast("string" if k == "kind" else "double") for k in side}
    total = {"constant": zero, "one": zero, "two": F.lit(-1e-7), "three": zero, "four": zero}
    value = scalars.trip_utility(F.col("departure"), F.lit(5.0), F.col("legs"), total, nothing, side)
    return d.frame(spark, sf_dir, d.TRIPS).join(legs, "trip_id").select("trip_id", r6(value).alias("utility"))


@query(
    """SELECT vehicle_id, edge_id, round(CASE kind WHEN 0 THEN least(speed, upper_bound) WHEN 1 THEN speed * coef
    ELSE CASE WHEN speed < 9 THEN speed WHEN speed > 11 THEN speed WHEN speed <= 10 THEN 8e0 + (speed - 9e0) * 1e0 ELSE 9e0 + (speed - 10e0) * 0.5e0 END END, 6) AS speed
  FROM <VEHICLES> v JOIN <EDGES> e ON e.source = v.vehicle_id"""
)
def speed_function(spark, sf_dir):
    both = d.frame(spark, sf_dir, d.VEHICLES).join(d.frame(spark, sf_dir, d.EDGES), F.col("source") == F.col("vehicle_id"))
    kind = F.when(F.col("kind") == 0, "UpperBound").when(F.col("kind") == 1, "Multiplicator").otherwise("Piecewise")
    value = scalars.vehicle_speed(F.col("speed"), kind, F.col("upper_bound"), F.col("coef"), F.lit([9.0, 10.0, 11.0]), F.lit([8.0, 9.0, 9.5]))
    return both.select("vehicle_id", "edge_id", r6(value).alias("speed"))


@query(
    """WITH o AS (SELECT request_id, r.edge_id % 3 AS kind, length, speed, length * lanes AS total, lanes, constant_travel_time AS c, CAST(request_id % 3000 AS DOUBLE) AS occ FROM <REQUESTS> r JOIN <EDGES> e ON e.edge_id = r.edge_id),
  s AS (SELECT *, CASE kind WHEN 0 THEN speed WHEN 1 THEN CASE WHEN occ <= 4e0 * (total / speed) THEN speed ELSE total / occ * 4e0 END
    ELSE CASE WHEN occ / total >= 0.8e0 THEN least(2e0, speed) WHEN occ / total > 0.2e0 THEN least(speed * (1 - pow((occ / total - 0.2e0) / 0.6e0, 1.5e0)) + 2e0 * pow((occ / total - 0.2e0) / 0.6e0, 1.5e0), speed) ELSE speed END END AS v FROM o)
  SELECT request_id, round(length / v + c, 6) AS travel_time FROM s"""
)
def edge_travel_time(spark, sf_dir):
    rows = d.frame(spark, sf_dir, d.REQUESTS).join(d.frame(spark, sf_dir, d.EDGES), "edge_id")
    kind = F.when(F.col("edge_id") % 3 == 0, "FreeFlow").when(F.col("edge_id") % 3 == 1, "Bottleneck").otherwise("ThreeRegimes")
    occupied = (F.col("request_id") % 3000).cast("double")
    speed = scalars.congested_speed(F.col("speed"), occupied, F.col("length") * F.col("lanes"), kind, F.lit(4.0), F.lit(0.2), F.lit(0.8), F.lit(2.0), F.lit(1.5))
    return rows.select("request_id", r6(scalars.edge_travel_time(F.col("length"), speed, F.col("constant_travel_time"))).alias("travel_time"))


@query(
    """SELECT request_id, round(coalesce((SELECT f FROM (VALUES (21600e0, 0.5e0), (36000e0, 0.2e0), (61200e0, 0.8e0)) x(s, f) WHERE s <= t ORDER BY s DESC LIMIT 1), 0.5e0), 6) AS flow,
  round(1e0 / (coalesce((SELECT f FROM (VALUES (21600e0, 0.5e0), (36000e0, 0.2e0), (61200e0, 0.8e0)) x(s, f) WHERE s <= t ORDER BY s DESC LIMIT 1), 0.5e0) * (1e0 + request_id % 50 % 3)), 6) AS closing FROM <REQUESTS> r"""
)
def flow_asof(spark, sf_dir):
    flow = scalars.flow_at(F.col("t"), F.lit([21600.0, 36000.0, 61200.0]), F.lit([0.5, 0.2, 0.8]))
    lanes = 1.0 + F.col("request_id") % 50 % 3
    return d.frame(spark, sf_dir, d.REQUESTS).select("request_id", r6(flow).alias("flow"), r6(scalars.closing_time(F.lit(1.0), flow, lanes)).alias("closing"))


@query(
    """SELECT trip_id, printf('%02d:%02d:%02d', departure::BIGINT // 3600, departure::BIGINT % 3600 // 60, departure::BIGINT % 60) AS clock,
  departure BETWEEN 21600e0 AND 43200e0 AS in_period, round(CASE WHEN trip_id % 10 = 0 THEN 0e0 ELSE (departure - (trip_id % 10)) / (trip_id % 10) END, 6) AS congestion FROM <TRIPS> t"""
)
def clock_and_congestion(spark, sf_dir):
    free = (F.col("trip_id") % 10).cast("double")
    return d.frame(spark, sf_dir, d.TRIPS).select(
        "trip_id", scalars.clock(F.col("departure")).alias("clock"), scalars.contains(F.lit(21600.0), F.lit(43200.0), F.col("departure")).alias("in_period"), r6(scalars.congestion(F.col("departure"), free)).alias("congestion")
    )


# --- choices -------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT *, v + [0e0, 1e0][alt % 2 + 1] AS x FROM <ALTERNATIVES> q), b AS (SELECT *, max(x) OVER (PARTITION BY agent_id) AS m FROM a),
  t AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY alt) - 1 AS i, count(*) OVER (PARTITION BY agent_id) AS n FROM b WHERE x = m)
  SELECT agent_id, alt AS chosen, m AS payoff FROM t WHERE i = least(floor(u * n), n - 1)"""
)
def choice_deterministic(spark, sf_dir):
    rows = d.frame(spark, sf_dir, d.ALTERNATIVES).withColumn("constants", F.lit([0.0, 1.0]))
    return choice.deterministic(rows, "agent_id", "alt", "v", "u", "constants")


@query(
    """WITH a AS (SELECT *, max(w) OVER (PARTITION BY agent_id) AS m FROM <ALTERNATIVES> q), e AS (SELECT *, exp((w - m) / mu) AS e FROM a),
  c AS (SELECT *, sum(e) OVER (PARTITION BY agent_id ORDER BY alt) AS c, sum(e) OVER (PARTITION BY agent_id) AS s FROM e)
  SELECT agent_id, min(alt) FILTER (c / s > u OR alt = 4) AS chosen, round(any_value(m) + any_value(mu) * (ln(any_value(s)) + 0.5772156649015329e0), 6) AS payoff FROM c GROUP BY agent_id"""
)
def choice_logit(spark, sf_dir):
    rows = d.frame(spark, sf_dir, d.ALTERNATIVES)
    return choice.logit(rows, "agent_id", "alt", "w", "u", "mu").select("agent_id", "chosen", r6("payoff").alias("payoff"))


@query(
    """WITH a AS (SELECT *, y - max(y) OVER (PARTITION BY agent_id) AS z, max(y) OVER (PARTITION BY agent_id) AS m FROM <UTILITIES> q),
  s AS (SELECT *, lead(z) OVER (PARTITION BY agent_id ORDER BY k) AS z1 FROM a),
  g AS (SELECT *, CASE WHEN z = z1 THEN exp(z / mu) * 900e0 ELSE mu * 900e0 / (z1 - z) * (exp(z1 / mu) - exp(z / mu)) END AS g FROM s WHERE z1 IS NOT NULL),
  c AS (SELECT *, sum(g) OVER (PARTITION BY agent_id ORDER BY k) AS c, sum(g) OVER (PARTITION BY agent_id) AS total FROM g),
  f AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY k) AS i FROM c WHERE c > u * total),
  r AS (SELECT *, u * total - (c - g) AS rest, (z1 - z) / 900e0 AS theta FROM f WHERE i = 1)
  SELECT agent_id, round(CASE WHEN z = z1 THEN x + rest / exp(z / mu) ELSE x + mu / theta * ln(theta * rest / mu + exp(z / mu)) - z / theta END, 4) AS departure_time, round(m + mu * (ln(total) + 0.5772156649015329e0), 6) AS payoff FROM r"""
)
def choice_continuous_logit(spark, sf_dir):
    rows = d.frame(spark, sf_dir, d.UTILITIES)
    built = pwl.build(rows, ["agent_id", "u", "mu"], "x", "y", 0.0)
    chosen = choice.continuous_logit(F.col("ttf"), F.col("u"), F.col("mu"))
    return built.select("agent_id", chosen.alias("c")).select("agent_id", F.round("c.x", 4).alias("departure_time"), r6("c.payoff").alias("payoff"))


@query(
    """SELECT c_custkey AS agent_id, k::BIGINT AS k, 21600e0 + step / 2e0 + k * step AS midpoint, least(greatest(21600e0 + step / 2e0 + k * step + step / 4e0, 21600e0), 25200e0) AS departure_time
  FROM (SELECT c_custkey, 300e0 * (1 + c_custkey % 4) AS step FROM customer) q, LATERAL (SELECT unnest(generate_series(0, 11)) AS k) g WHERE 21600e0 + step / 2e0 + k * step < 25200e0"""
)
def departure_grid(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    step = 300.0 * (1 + F.col("c_custkey") % 4)
    rows = customers.select(F.col("c_custkey").alias("agent_id"), step.alias("step"), F.posexplode(choice.departure_grid(21600.0, 25200.0, step)).alias("k", "midpoint"))
    return rows.select("agent_id", F.col("k").cast("bigint").alias("k"), "midpoint", choice.shifted_departure(F.col("midpoint"), F.col("step") / 4, 21600.0, 25200.0).alias("departure_time"))


@query(
    """SELECT agent_id, row_number() OVER (ORDER BY h, agent_id) <= floor(0.1e0 * count(*) OVER ()) AS updates
  FROM (SELECT c_custkey AS agent_id, ('0x' || substr(md5('43:' || c_custkey::VARCHAR), 1, 15))::BIGINT AS h FROM customer) q"""
)
def update_mask(spark, sf_dir):
    """A tenth of all agents updates; which ones is decided by a hash."""
    return choice.update_mask(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("agent_id")), "agent_id", 0.1, 42, 1)


# --- network -------------------------------------------------------------------------------


@query("SELECT source AS node_id FROM <EDGES> e UNION SELECT target FROM <EDGES> e")
def node_set(spark, sf_dir):
    return network.nodes(d.frame(spark, sf_dir, d.EDGES))


@query(
    "SELECT min(vehicle_id) AS uvehicle, count(*)::BIGINT AS vehicles, max(vehicle_id) AS last_vehicle FROM <VEHICLES> v GROUP BY kind, CASE kind WHEN 0 THEN upper_bound WHEN 1 THEN coef ELSE 0e0 END, banned"
)
def unique_vehicles(spark, sf_dir):
    v = _vehicles(spark, sf_dir)
    got = network.unique_vehicles(v)
    return got.select("uvehicle", F.size("vehicle_ids").cast("bigint").alias("vehicles"), F.array_max("vehicle_ids").alias("last_vehicle"))


def _vehicles(spark, sf_dir) -> DataFrame:
    v = d.frame(spark, sf_dir, d.VEHICLES)
    kind = F.when(F.col("kind") == 0, "UpperBound").when(F.col("kind") == 1, "Multiplicator").otherwise("Piecewise")
    none = F.lit(None)
    return v.select(
        "vehicle_id",
        kind.alias("speed_type"),
        F.when(F.col("kind") == 0, F.col("upper_bound")).alias("upper_bound"),
        F.when(F.col("kind") == 1, F.col("coef")).alias("coef"),
        F.when(F.col("kind") == 2, F.lit([9.0, 11.0])).alias("x"),
        F.when(F.col("kind") == 2, F.lit([8.0, 10.0])).alias("y"),
        none.cast("array<bigint>").alias("allowed_edges"),
        F.array("banned").alias("restricted_edges"),
    )


@query("SELECT uvehicle, origin, destination, bool_or(dt_kind > 0) AS requires_profile FROM <TRIPS> t GROUP BY ALL")
def od_pairs(spark, sf_dir):
    trips = d.frame(spark, sf_dir, d.TRIPS)
    kind = F.when(F.col("dt_kind") == 0, "Constant").when(F.col("dt_kind") == 1, "Discrete").otherwise("Continuous")
    return network.od_pairs(trips.select("uvehicle", "origin", "destination", F.lit("Road").alias("class_type"), F.lit(None).alias("route"), kind.alias("dt_choice_type")))


@query(
    """WITH p AS (SELECT DISTINCT uvehicle, origin, destination FROM <TRIPS> t), o AS (SELECT origin FROM p GROUP BY origin HAVING count(*) >= 20), e AS (SELECT destination FROM p GROUP BY destination HAVING count(*) >= 20)
  SELECT origin AS node, count(*)::BIGINT AS pairs, 'origin' AS side FROM p JOIN e USING (destination) GROUP BY origin HAVING count(*) >= 20
  UNION ALL SELECT destination, count(*)::BIGINT, 'destination' FROM p JOIN o USING (origin) GROUP BY destination HAVING count(*) >= 20"""
)
def popular_nodes(spark, sf_dir):
    return network.popular_nodes(d.frame(spark, sf_dir, d.TRIPS).select("uvehicle", "origin", "destination").distinct())


@query("SELECT vehicle_id, count(*)::BIGINT AS edges, sum(edge_id)::BIGINT AS edge_sum FROM <VEHICLES> v JOIN <EDGES> e ON edge_id <> banned GROUP BY vehicle_id")
def edge_access(spark, sf_dir):
    return network.access_totals(_vehicles(spark, sf_dir), d.frame(spark, sf_dir, d.EDGES))


@query(
    """WITH u AS (SELECT kind, CASE kind WHEN 0 THEN upper_bound ELSE 0e0 END AS ub, CASE kind WHEN 1 THEN coef ELSE 0e0 END AS coef, banned, min(vehicle_id) AS uvehicle FROM <VEHICLES> v GROUP BY ALL)
  SELECT uvehicle, edge_id, round(length / CASE kind WHEN 0 THEN least(speed, ub) WHEN 1 THEN speed * coef WHEN 2 THEN CASE WHEN speed BETWEEN 9 AND 11 THEN speed - 1e0 ELSE speed END END + constant_travel_time, 6) AS travel_time FROM u JOIN <EDGES> e ON edge_id <> banned"""
)
def free_flow(spark, sf_dir):
    v = _vehicles(spark, sf_dir)
    kept = network.unique_vehicles(v).select("uvehicle", F.col("uvehicle").alias("vehicle_id")).join(v, "vehicle_id")
    return network.free_flow_weights(kept, d.frame(spark, sf_dir, d.EDGES)).select("uvehicle", "edge_id", r6("travel_time").alias("travel_time"))


@query("SELECT trip_id, sum(length) AS length, round(sum(length / speed), 6) AS free_flow_travel_time, count(*)::BIGINT AS nb_edges FROM <ROUTES> r JOIN <EDGES> e ON e.edge_id = r.edge_id GROUP BY trip_id")
def route_metrics(spark, sf_dir):
    weights = d.frame(spark, sf_dir, d.EDGES).select("edge_id", "length", (F.col("length") / F.col("speed")).alias("travel_time"))
    got = network.route_metrics(d.frame(spark, sf_dir, d.ROUTES), weights)
    return got.select("trip_id", "length", r6("free_flow_travel_time").alias("free_flow_travel_time"), "nb_edges")


@query(
    """SELECT r.trip_id, sum(CASE WHEN o.trip_id IS NULL THEN length ELSE 0e0 END) AS length_diff FROM <ROUTES> r
  LEFT JOIN (SELECT DISTINCT trip_id, other_edge FROM <ROUTES> q) o ON o.trip_id = r.trip_id AND o.other_edge = r.edge_id JOIN <EDGES> e ON e.edge_id = r.edge_id GROUP BY r.trip_id"""
)
def route_diff(spark, sf_dir):
    routes = d.frame(spark, sf_dir, d.ROUTES)
    others = routes.select("trip_id", F.col("other_edge").alias("edge_id"))
    return network.route_difference(routes, others, d.frame(spark, sf_dir, d.EDGES))


@query(
    """WITH r AS (SELECT r.trip_id, position, edge_id, departure + sum(spent) OVER w - spent AS entry_time, departure + sum(spent) OVER (PARTITION BY r.trip_id) AS arrival FROM <ROUTES> r JOIN <TRIPS> t ON t.trip_id = r.trip_id WINDOW w AS (PARTITION BY r.trip_id ORDER BY position))
  SELECT trip_id, position, edge_id, entry_time, coalesce(lead(entry_time) OVER (PARTITION BY trip_id ORDER BY position), arrival) AS exit_time FROM r"""
)
def route_results(spark, sf_dir):
    from pyspark.sql import Window

    routes = d.frame(spark, sf_dir, d.ROUTES).join(d.frame(spark, sf_dir, d.TRIPS), "trip_id")
    so_far = F.sum("spent").over(Window.partitionBy("trip_id").orderBy("position")) - F.col("spent")
    events = routes.select("trip_id", "position", "edge_id", (F.col("departure") + so_far).alias("entry_time"))
    arrivals = routes.groupBy("trip_id").agg((F.first("departure") + F.sum("spent")).alias("arrival_time"))
    return network.route_results(events, arrivals)


@query("SELECT trip_id, count(*)::BIGINT - count(DISTINCT edge_id)::BIGINT AS repeats FROM <ROUTES> r GROUP BY trip_id HAVING count(*) > count(DISTINCT edge_id)")
def looping_routes(spark, sf_dir):
    return network.looping_routes(d.frame(spark, sf_dir, d.ROUTES))


@query("SELECT node_id, count(*)::BIGINT AS trips FROM (SELECT origin * 2 AS node_id FROM <TRIPS> t UNION ALL SELECT destination FROM <TRIPS> t) e WHERE node_id >= <NODES> GROUP BY node_id")
def unknown_nodes(spark, sf_dir):
    trips = d.frame(spark, sf_dir, d.TRIPS).select((F.col("origin") * 2).alias("origin"), "destination")
    return network.unknown_ends(trips, d.frame(spark, sf_dir, d.EDGES))


@query("SELECT s AS source, t AS target, count(*)::BIGINT AS edges FROM (SELECT source % 5 AS s, target % 5 AS t FROM <EDGES> e) q GROUP BY ALL HAVING count(*) > 1")
def parallel_edges(spark, sf_dir):
    return network.parallel_edges(d.frame(spark, sf_dir, d.EDGES).select((F.col("source") % 5).alias("source"), (F.col("target") % 5).alias("target")))


@query("SELECT l_orderkey AS trip_id, round(30e0 + sum(l_quantity), 6) AS stopping_time FROM lineitem GROUP BY l_orderkey")
def stopping_time(spark, sf_dir):
    stops = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.collect_list("l_quantity").alias("stops"))
    return stops.select("trip_id", r6(scalars.total_stopping_time(F.lit(30.0), F.col("stops"))).alias("stopping_time"))


@query("SELECT count(DISTINCT edge_id)::BIGINT * 2 AS functions, count(DISTINCT edge_id)::BIGINT AS constants, count(*)::BIGINT AS points FROM <GRID> g")
def weights_complexity(spark, sf_dir):
    both = _functions(spark, sf_dir, "y")
    constants = both.select("edge_id", pwl.constant(F.lit(1.0)).cast(pwl.TYPE).alias("ttf"))
    return summary.complexity(both.select("edge_id", F.col("y").alias("ttf")).unionByName(constants))


@query("SELECT agent_id, count(*) FILTER (trip_id % 3 > 0)::BIGINT AS nb_road_trips, count(*) FILTER (trip_id % 3 = 0)::BIGINT AS nb_virtual_trips, sum(CASE WHEN trip_id % 3 > 0 THEN trip_id % 7 ELSE 0 END)::BIGINT AS nb_edges FROM <TRIPS> t GROUP BY agent_id")
def travel_counts(spark, sf_dir):
    road = F.col("trip_id") % 3 > 0
    return summary.travel_counts(d.frame(spark, sf_dir, d.TRIPS).select("agent_id", F.when(road, "Road").otherwise("Virtual").alias("class_type"), F.when(road, F.col("trip_id") % 7).alias("nb_edges")))


# --- learning ------------------------------------------------------------------------------


def _learn(model: str, iteration: int, value: float | None = None):
    def run(spark, sf_dir):
        f = learning.learn(F.col("y"), F.col("y2"), model, F.lit(iteration), value)
        return _long(_functions(spark, sf_dir, "y", "y2"), f, "edge_id")

    return run


def _averaged(weight: str) -> str:
    return f"SELECT edge_id, k, round(y * (1e0 - {weight}) + y2 * {weight}, 6) AS value FROM <GRID> g"


for _name, _model, _value, _sql in (
    ("learn_linear", "Linear", None, _averaged("1e0 / 4e0")),
    ("learn_quadratic", "Quadratic", None, _averaged("1e0 / (sqrt(3e0) + 1e0)")),
    ("learn_exponential", "Exponential", 0.4, _averaged("0.4e0 / (1e0 - pow(0.6e0, 4e0))")),
    ("learn_exponential_unadjusted", "ExponentialUnadjusted", 0.4, _averaged("0.4e0")),
    ("learn_genetic", "Genetic", None, "SELECT edge_id, k, round(pow(y, 0.75e0) * pow(y2, 0.25e0), 6) AS value FROM <GRID> g"),
):
    _f = _learn(_model, 3, _value)
    _f.__name__ = _name
    query(_sql)(_f)


@query(
    """SELECT round(sqrt(avg(s)), 6) AS rmse FROM (SELECT edge_id, sum(d0 * d0 + d0 * d1 + d1 * d1) / 3e0 / 24e0 AS s
  FROM (SELECT edge_id, y - y2 AS d0, lead(y - y2) OVER (PARTITION BY edge_id ORDER BY k) AS d1 FROM <GRID> g) q WHERE d1 IS NOT NULL GROUP BY edge_id) z"""
)
def weights_rmse(spark, sf_dir):
    both = _functions(spark, sf_dir, "y", "y2")
    a, b = (both.select(F.lit(0).alias("uvehicle"), "edge_id", F.col(c).alias("ttf")) for c in ("y", "y2"))
    return learning.weights_rmse(a, b).select(r6("rmse").alias("rmse"))


# --- summaries -----------------------------------------------------------------------------


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS q_mean, round(stddev_pop(l_quantity), 6) AS q_std, min(l_quantity) AS q_min, max(l_quantity) AS q_max FROM lineitem GROUP BY l_returnflag")
def distribution(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = table.groupBy("l_returnflag").agg(*summary.distribution(F.col("l_quantity"), "q"))
    return got.select("l_returnflag", r6("q_mean").alias("q_mean"), r6("q_std").alias("q_std"), "q_min", "q_max")


_DIST = ", ".join(
    f"round(avg({x}), 6) AS {n}_mean, round(stddev_pop({x}), 6) AS {n}_std, round(min({x}), 6) AS {n}_min, round(max({x}), 6) AS {n}_max"
    for n, x in (("alt_departure_time", "dep"), ("alt_arrival_time", "dep + tt"), ("alt_travel_time", "tt"), ("alt_utility", "-tt / 60e0"), ("alt_expected_utility", "-tt / 90e0"), ("alt_dep_time_shift", "abs(shift)"))
)


@query(
    f"""SELECT count(*)::BIGINT AS trip_alt_count, {_DIST}, round(sqrt(avg(shift * shift)), 6) AS alt_dep_time_rmse FROM (SELECT departure AS dep, CAST((trip_id * 13) % 3600 AS DOUBLE) AS tt, CAST(trip_id % 600 AS DOUBLE) - 300e0 AS shift FROM <TRIPS> t) q"""
)
def trip_aggregates(spark, sf_dir):
    tt = ((F.col("trip_id") * 13) % 3600).cast("double")
    rows = d.frame(spark, sf_dir, d.TRIPS).select(
        F.col("departure").alias("departure_time"), (F.col("departure") + tt).alias("arrival_time"), tt.alias("total_travel_time"), (-tt / 60).alias("utility"), (-tt / 90).alias("alt_expected_utility"), ((F.col("trip_id") % 600).cast("double") - 300).alias("departure_time_shift")
    )
    got = rows.agg(*summary.trip_aggregates(rows))
    return got.select("trip_alt_count", *[r6(c).alias(c) for c in got.columns[1:]])


@query(
    """WITH v AS (SELECT departure + 50e0 * (trip_id % 100) AS x FROM <TRIPS> t), e AS (SELECT least(min(x), 0e0) AS lo, greatest(max(x), 86400e0) AS hi FROM v),
  c AS (SELECT least(greatest(ceil((x - lo) / ((hi - lo) / 128)), 1), 128)::BIGINT - 1 AS bin, count(*) AS n FROM v, e GROUP BY 1)
  SELECT g.bin::BIGINT AS bin, round(lo + g.bin * ((hi - lo) / 128), 6) AS bin_start, coalesce(n, 0)::BIGINT AS count FROM (SELECT unnest(generate_series(0, 127)) AS bin) g CROSS JOIN e LEFT JOIN c ON c.bin = g.bin"""
)
def histogram128(spark, sf_dir):
    rows = d.frame(spark, sf_dir, d.TRIPS).select((F.col("departure") + 50.0 * (F.col("trip_id") % 100)).alias("x"))
    return summary.histogram(rows, "x", 0.0, 86400.0).select(F.col("bin").cast("bigint").alias("bin"), r6("bin_start").alias("bin_start"), F.col("count").cast("bigint").alias("count"))


@query(
    """SELECT c_custkey AS agent_id, c_custkey % 3 <> c_custkey % 2 AS shifted_alt, CASE WHEN c_custkey % 3 = c_custkey % 2 THEN CAST(c_custkey % 700 AS DOUBLE) - (c_custkey % 500) END AS departure_time_shift FROM customer"""
)
def prev_iteration_diff(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    now = c.select(key.alias("agent_id"), (key % 3).alias("selected_alt_id"), (key % 700).cast("double").alias("departure_time"))
    before = c.select(key.alias("agent_id"), (key % 2).alias("selected_alt_id"), (key % 500).cast("double").alias("departure_time"))
    return summary.previous_differences(now, before)


from wayfare.plans import catalogue_day, catalogue_functions, catalogue_routing, catalogue_tables  # noqa: E402, F401 (they register their queries)
