"""Queries of functions of time, formulas and choices that the main catalogue leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions import pwl, scalars
from wayfare.operators import choice, learning, summary
from wayfare.plans import derived as d
from wayfare.plans.catalogue import _functions, _long, query, r6
from wayfare.sources.shared import cut
from wayfare.streaming import gates


@query(
    """SELECT edge_id, min(y) AS least, max(y) AS greatest, min(y) = max(y) AS is_constant, max(y) - min(y) <= 95e0 AS nearly, count(*)::BIGINT AS points, 3600e0 * 12 AS middle, 86400e0 AS period
  FROM <GRID> g GROUP BY edge_id"""
)
def pwl_properties(spark, sf_dir):
    f = F.col("y")
    return _functions(spark, sf_dir, "y").select(
        "edge_id", pwl.least(f).alias("least"), pwl.greatest(f).alias("greatest"), pwl.is_constant(f).alias("is_constant"), pwl.practically_constant(f, F.lit(95.0)).alias("nearly"),
        pwl.complexity(f).cast("bigint").alias("points"), pwl.middle_x(f).alias("middle"), pwl.period_length(f).alias("period"),
    )


@query("SELECT edge_id, k, x AS x0, y AS y0, x + 3600e0 AS x1, y1 FROM (SELECT *, lead(y) OVER (PARTITION BY edge_id ORDER BY k) AS y1 FROM <GRID> g) q WHERE y1 IS NOT NULL")
def pwl_pairs(spark, sf_dir):
    """Consecutive points."""
    rows = _functions(spark, sf_dir, "y").select("edge_id", F.posexplode(pwl.pairs(F.col("y"))).alias("k", "p"))
    return rows.select("edge_id", F.col("k").cast("bigint").alias("k"), "p.x0", "p.y0", "p.x1", "p.y1")


@query("SELECT edge_id, k, round(y * 1.5e0 + 7e0, 6) AS value FROM <GRID> g")
def pwl_map(spark, sf_dir):
    return _long(_functions(spark, sf_dir, "y"), pwl.add(pwl.apply_values(F.col("y"), lambda y: y * 1.5), F.lit(7.0)), "edge_id")


_AT_90 = "(SELECT f.edge_id, f.k, f.y, coalesce(b.y, f.y) AS y1, 90e0 / 3600e0 AS share FROM <GRID> f LEFT JOIN <GRID> b ON b.edge_id = f.edge_id AND b.k = f.k + 1)"


@query(f"SELECT edge_id, k, round(y + 90e0, 6) AS after, round(90e0 + y + share * (y1 - y), 6) AS before FROM {_AT_90} q")
def pwl_link_constants(spark, sf_dir):
    """A constant of 90 seconds behind a function, and before it."""
    f, c = F.col("y"), pwl.constant(F.lit(90.0))
    both = _functions(spark, sf_dir, "y").select("edge_id", pwl.link(f, c).alias("after"), pwl.link(c, f).alias("before"))
    rows = both.select("edge_id", F.posexplode(F.arrays_zip(F.col("after.points").alias("after"), F.col("before.points").alias("before"))).alias("k", "p"))
    return rows.select("edge_id", F.col("k").cast("bigint").alias("k"), r6("p.after").alias("after"), r6("p.before").alias("before"))


@query("SELECT edge_id, k, least(y, 90e0) AS value FROM <GRID> g WHERE edge_id IN (SELECT edge_id FROM <GRID> h GROUP BY edge_id HAVING min(y) < 90e0 AND max(y) > 90e0)")
def pwl_merge_constant(spark, sf_dir):
    """The lesser of a function and 90 seconds, where neither is below the other everywhere."""
    got = _functions(spark, sf_dir, "y").select("edge_id", "y", pwl.merge(F.col("y"), pwl.constant(F.lit(90.0))).alias("m"))
    return _long(got.where((pwl.least(F.col("y")) < 90) & (pwl.greatest(F.col("y")) > 90)), F.col("m"), "edge_id")


@query("SELECT edge_id, CASE WHEN max(y) <= min(y2) THEN 'first' WHEN max(y2) <= min(y) THEN 'second' ELSE 'both' END AS kept, bool_or(y < y2) AS undercuts FROM <GRID> g GROUP BY edge_id")
def pwl_undercut(spark, sf_dir):
    """Which of two functions the lesser one is, and whether the first is below the second anywhere."""
    f, g = F.col("y"), F.col("y2")
    kept = F.when(pwl.greatest(f) <= pwl.least(g), "first").when(pwl.greatest(g) <= pwl.least(f), "second").otherwise("both")
    return _functions(spark, sf_dir, "y", "y2").select("edge_id", kept.alias("kept"), pwl.undercuts(f, g).alias("undercuts"))


@query("SELECT edge_id, k, x, y FROM <GRID> g")
def pwl_values(spark, sf_dir):
    """A function as JSON values and back, as points."""
    text = _functions(spark, sf_dir, "y").select("edge_id", pwl.to_json_values(F.col("y.points")).alias("text"))
    f = pwl.from_values(F.lit(0.0), F.lit(3600.0), pwl.from_json_values(F.col("text")))
    rows = text.select("edge_id", f.alias("f")).select("edge_id", "f", F.posexplode("f.points").alias("k", "y"))
    return rows.select("edge_id", F.col("k").cast("bigint").alias("k"), pwl.x_at(F.col("f"), F.col("k")).alias("x"), "y")


@query("SELECT edge_id, edge_id * 1e0 AS value, TRUE AS is_constant, 0::BIGINT AS points FROM <EDGES> e")
def pwl_constants(spark, sf_dir):
    """Equal values make a constant, as one point does."""
    edges = d.frame(spark, sf_dir, d.EDGES)
    rows = edges.select("edge_id", F.explode(F.sequence(F.lit(0), (F.col("edge_id") % 3).cast("int"))).alias("k")).select("edge_id", (F.col("k") * 60.0).alias("x"), F.col("edge_id").cast("double").alias("y"))
    got = pwl.build(rows, ["edge_id"], "x", "y")
    return got.select("edge_id", pwl.evaluate(F.col("ttf"), F.lit(123.0)).alias("value"), pwl.is_constant(F.col("ttf")).alias("is_constant"), pwl.complexity(F.col("ttf")).cast("bigint").alias("points"))


@query("SELECT DISTINCT c_custkey AS agent_id, unnest([tstar - delta / 2, tstar + delta / 2]) AS kink FROM (SELECT c_custkey, 30000e0 + c_custkey AS tstar, 600e0 * (c_custkey % 3) AS delta FROM customer) q")
def schedule_kinks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kinks = scalars.schedule_kinks(F.col("c_custkey") + 30000.0, 600.0 * (F.col("c_custkey") % 3))
    return c.select(F.col("c_custkey").alias("agent_id"), F.explode(kinks).alias("kink"))


@query("SELECT trip_id, round(CASE WHEN e = 0 THEN 0e0 ELSE (a - e) / e END, 6) AS relative, abs(a - e) AS absolute FROM (SELECT trip_id, CAST(trip_id % 1000 AS DOUBLE) AS a, CAST(trip_id % 7 * 100 AS DOUBLE) AS e FROM <TRIPS> t) q")
def expected_differences(spark, sf_dir):
    a, e = (F.col("trip_id") % 1000).cast("double"), (F.col("trip_id") % 7 * 100).cast("double")
    return d.frame(spark, sf_dir, d.TRIPS).select("trip_id", r6(scalars.relative_difference(a, e)).alias("relative"), F.abs(a - e).alias("absolute"))


@query(
    """WITH a AS (SELECT *, max(y) OVER (PARTITION BY agent_id) AS m FROM <UTILITIES> q), e AS (SELECT *, exp((y - m) / 1e-6) AS e FROM a),
  c AS (SELECT *, sum(e) OVER (PARTITION BY agent_id ORDER BY k) AS c, sum(e) OVER (PARTITION BY agent_id) AS s FROM e)
  SELECT agent_id, min(x) FILTER (c > u * s OR k = 8) AS departure_time, round(any_value(m) + 1e-6 * (ln(any_value(s)) + 0.5772156649015329e0), 6) AS payoff FROM c
  WHERE agent_id IN (SELECT agent_id FROM (SELECT *, lead(y) OVER (PARTITION BY agent_id ORDER BY k) AS y1 FROM <UTILITIES> r) z GROUP BY agent_id HAVING NOT bool_or(coalesce(y = y1, FALSE))) GROUP BY agent_id"""
)
def choice_underflow(spark, sf_dir):
    """A scale so small that nothing but the greatest points counts: steep segments only, chosen between as points."""
    built = pwl.build(d.frame(spark, sf_dir, d.UTILITIES), ["agent_id", "u"], "x", "y", 0.0)
    steep = built.where(~F.exists(pwl.pairs(F.col("ttf")), lambda p: p["y0"] == p["y1"]))
    # each segment spans a thousandth of a nanosecond: its integral is no number above zero
    tiny = steep.withColumn("f", pwl.piecewise(F.lit(0.0), F.lit(5e-324), F.col("ttf.points")))
    chosen = tiny.select("agent_id", "ttf", choice.continuous_logit(F.col("f"), F.col("u"), F.lit(1e-6)).alias("c"))
    return chosen.select("agent_id", (F.round(F.col("c.x") / F.lit(5e-324)) * 900.0).alias("departure_time"), r6("c.payoff").alias("payoff"))


@query(
    """WITH a AS (SELECT *, ['First', 'Deterministic', 'Logit'][agent_id % 3 + 1] AS kind FROM <ALTERNATIVES> q),
  f AS (SELECT agent_id, 0::BIGINT AS chosen, max(w) FILTER (alt = 0) AS payoff FROM a WHERE kind = 'First' GROUP BY agent_id),
  t AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY alt) - 1 AS i, count(*) OVER (PARTITION BY agent_id) AS n FROM (SELECT *, max(w) OVER (PARTITION BY agent_id) AS m FROM a WHERE kind = 'Deterministic') z WHERE w = m),
  e AS (SELECT *, exp((w - m) / mu) AS e FROM (SELECT *, max(w) OVER (PARTITION BY agent_id) AS m FROM a WHERE kind = 'Logit') z),
  c AS (SELECT *, sum(e) OVER (PARTITION BY agent_id ORDER BY alt) AS c, sum(e) OVER (PARTITION BY agent_id) AS s FROM e)
  SELECT agent_id, chosen, round(payoff, 6) AS payoff FROM f UNION ALL SELECT agent_id, alt, round(m, 6) FROM t WHERE i = least(floor(u * n), n - 1)
  UNION ALL SELECT agent_id, min(alt) FILTER (c / s > u OR alt = 4), round(any_value(m) + any_value(mu) * (ln(any_value(s)) + 0.5772156649015329e0), 6) FROM c GROUP BY agent_id"""
)
def choice_models(spark, sf_dir):
    """Each agent by its own model: the first alternative, the best one, or a logit."""
    rows = d.frame(spark, sf_dir, d.ALTERNATIVES)
    kind = F.get(F.array(F.lit("First"), F.lit("Deterministic"), F.lit("Logit")), (F.col("agent_id") % 3).cast("int"))
    rows = rows.withColumn("kind", kind).withColumn("constants", F.array().cast("array<double>"))
    return choice.choose(rows, "agent_id", "alt", "w", "kind", "u", "mu", "constants").select("agent_id", "chosen", r6("payoff").alias("payoff"))


@query("SELECT edge_id, 1::BIGINT AS uvehicle, k, round(y * 0.75e0 + y2 * 0.25e0, 6) AS value FROM <GRID> g")
def learn_tables(spark, sf_dir):
    """The next expected weights of a whole table."""
    both = cut(_functions(spark, sf_dir, "y", "y2"), "weights")
    old, new = (both.select(F.lit(1).cast("bigint").alias("uvehicle"), "edge_id", F.col(c).alias("ttf")) for c in ("y", "y2"))
    return _long(learning.learn_weights(old, new, "Linear", 3), F.col("ttf"), "edge_id", "uvehicle")


@query("SELECT c_custkey AS counter, 1 + c_custkey - 1 >= 30 AS stops FROM customer WHERE c_custkey < 100")
def stop_rule(spark, sf_dir):
    """Whether the iteration of each counter is the last of thirty that began at 1."""
    return spark.createDataFrame([(k, learning.stop(k, 1, 30)) for k in range(100)], "counter bigint, stops boolean")


@query(
    """WITH r AS (SELECT *, max(x + steep - k * 1e-8) OVER (PARTITION BY edge_id ORDER BY k) + k * 1e-8 - x AS wait FROM <GRID> g),
  j AS (SELECT r.edge_id, r.k, r.x, r.wait, 70e0 AS spent FROM r) SELECT edge_id, k, round(wait + spent, 4) AS value FROM j"""
)
def simulated_weights(spark, sf_dir):
    """Wait to enter, travel and wait to leave as one function, first in, first out; here a varying wait before a constant road."""
    f = _functions(spark, sf_dir, "steep")
    entry = pwl.ensure_fifo(F.col("steep"))
    made = gates.simulated_weights(entry, pwl.constant(F.lit(70.0)).cast(pwl.TYPE), pwl.constant(F.lit(0.0)).cast(pwl.TYPE))
    rows = f.select("edge_id", made.alias("m")).select("edge_id", F.posexplode("m.points").alias("k", "y"))
    return rows.select("edge_id", F.col("k").cast("bigint").alias("k"), F.round("y", 4).alias("value"))


@query(
    """SELECT request_id, round(max(x) OVER (PARTITION BY edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING) + before, 6) AS exit_time FROM
  (SELECT *, t - before AS x FROM (SELECT request_id, r.edge_id, t, sum(1e0 / (flow * lanes)) OVER (PARTITION BY r.edge_id ORDER BY t, request_id ROWS UNBOUNDED PRECEDING) - 1e0 / (flow * lanes) AS before FROM <REQUESTS> r JOIN <EDGES> e ON e.edge_id = r.edge_id) a) b"""
)
def fifo_gate_stretches(spark, sf_dir):
    """Gates summed up by stretches of an hour, for roads that see a great part of all arrivals."""
    arrivals = d.frame(spark, sf_dir, d.REQUESTS).withColumn("position", F.col("request_id")).join(d.frame(spark, sf_dir, d.EDGES), "edge_id")
    got = gates.fifo_gate(arrivals, "edge_id", "t", scalars.closing_time(F.lit(1.0), F.col("flow"), F.col("lanes")), 3600.0)
    return got.select("request_id", r6("exit_time").alias("exit_time"))


@query("SELECT count(*)::BIGINT AS agents, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM (SELECT count(*) AS n FROM <TRIPS> t GROUP BY agent_id) q")
def trips_by_agent(spark, sf_dir):
    """Agents with a trip at least, and how many they have."""
    got = summary.by_agent(d.frame(spark, sf_dir, d.TRIPS), "trip")
    four = [f"trip_count_by_agent_{k}" for k in ("mean", "std", "min", "max")]
    return got.select(F.col("nb_agents_at_least_one_trip").alias("agents"), r6(four[0]).alias("mean"), r6(four[1]).alias("std"), F.col(four[2]).alias("least"), F.col(four[3]).alias("most"))


def _scenario(trips: list[tuple[float, list[int]]], lengths: list[float], headway: float, expected: list[tuple[float, float, float]]):
    """SQL of a scenario whose times are known, once for each supplier, on roads of its own and a minute later each."""
    rows = ", ".join(f"({i}, {a}e0, {b}e0, {c}e0)" for i, (a, b, c) in enumerate(expected))
    sql = f"SELECT s_suppkey * 100 + i AS trip_id, arrival + 60e0 * s_suppkey AS arrival_time, road AS road_time, waits AS in_bottleneck_time FROM supplier CROSS JOIN (VALUES {rows}) x(i, arrival, road, waits)"

    def run(spark, sf_dir, **options):
        from wayfare.plans.within_day import simulate_events

        s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
        listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t"), F.array(*[F.lit(e) for e in way]).alias("way")) for i, (t, way) in enumerate(trips)])
        each = s.select("s_suppkey", F.explode(listed).alias("x")).select("s_suppkey", (F.col("s_suppkey") * 100 + F.col("x.i")).alias("trip_id"), (F.col("x.t") + F.col("s_suppkey") * 60.0).alias("departure"), "x.way")
        routes = each.select("trip_id", "s_suppkey", F.posexplode("way").alias("position", "e")).select("trip_id", "position", (F.col("s_suppkey") * 10 + F.col("e")).alias("edge_id"))
        roads = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("length")) for i, x in enumerate(lengths)])
        edges = s.select("s_suppkey", F.explode(roads).alias("x")).select((F.col("s_suppkey") * 10 + F.col("x.i")).alias("edge_id"), "x.length", F.lit(1.0).alias("speed"), F.lit(1.0).alias("lanes"), F.lit(None).cast("double").alias("flow"))
        got = simulate_events(each.select("trip_id", "departure"), routes, edges, headway, spillback=True, **options)
        return got.select("trip_id", r6("arrival_time").alias("arrival_time"), r6("road_time").alias("road_time"), r6("in_bottleneck_time").alias("in_bottleneck_time"))

    return sql, run


# Two roads of 10 m for vehicles of 6 m: two fit; a third waits until one leaves.
_QUEUE_SQL, _queue = _scenario([(0, [0, 1]), (7, [1]), (5, [0, 1]), (6, [0, 1]), (9, [0, 1]), (30, [0, 1])], [10, 10], 6.0, [(20, 20, 0), (17, 10, 0), (27, 20, 2), (30, 20, 4), (37, 20, 8), (50, 20, 0)])


@query(_QUEUE_SQL)
def spillback_events(spark, sf_dir):
    """Vehicles wait for room on the road ahead."""
    return _queue(spark, sf_dir, max_pending=1000.0)


# Four roads of 5 m in a ring, each full with one vehicle: all wait for one another until each is let in by force after 10 s.
_RING_SQL, _ring = _scenario([(0, [0, 1, 2]), (2, [1, 2, 3]), (1, [2, 3, 0]), (3, [3, 0, 1])], [5] * 4, 6.0, [(25, 15, 10), (25, 15, 8), (25, 15, 9), (25, 15, 7)])


@query(_RING_SQL)
def gridlock_events(spark, sf_dir):
    """A gridlock ends by forced releases."""
    return _ring(spark, sf_dir, max_pending=10.0)
