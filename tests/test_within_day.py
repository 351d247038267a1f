"""Components of trips, and the event model over tables."""

import random

import pytest
from pyspark.sql import functions as F

from wayfare.functions import scalars
from wayfare.plans import within_day
from wayfare.plans.within_day import components, simulate_events, simulate_routes
from wayfare.streaming import gates
from wayfare.streaming.supply import Edge, Leg, Simulation, Trip, Vehicle


def test_components(spark):
    routes = [(k, e) for k in range(30) for e in (k, k + 1)] + [(100, 77), (101, 78), (102, 77), (103, 90), (103, 78)]
    got = {r.trip_id: r.component for r in components(spark.createDataFrame(routes, "trip_id long, edge_id long")).collect()}
    assert {got[k] for k in range(30)} == {0} and got[100] == got[102] == 77 and got[101] == got[103] == 78


def test_bottleneck_over_tables(spark):
    edges = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 0.5), (1, 1.0, 1.0, 1.0, 0.25), (5, 1.0, 1.0, 1.0, None)], "edge_id long, length double, speed double, lanes double, flow double")
    departures = spark.createDataFrame([(i, float(t)) for i, t in enumerate([0, 3, 4, 5, 10, 21])] + [(9, 2.0)], "trip_id long, departure double")
    routes = departures.where("trip_id < 9").select("trip_id", F.posexplode(F.array(F.lit(0), F.lit(1))).alias("position", "edge_id"))
    routes = routes.select("trip_id", "position", F.col("edge_id").cast("long").alias("edge_id")).unionByName(spark.createDataFrame([(9, 0, 5)], "trip_id long, position int, edge_id long"))
    got = {r.trip_id: r.arrival_time for r in simulate_routes(departures, routes, edges, headway=1.0).collect()}
    assert [got[i] for i in range(6)] == [2, 6, 10, 14, 18, 23] and got[9] == 3


def test_rounds_find_the_times_of_the_events(spark):
    """Random routes over few narrow edges, some used by all, no two times equal: the relational form against the event model."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(e, 100.0 + 17 * e + rng.random(), 10.0, 1.0, None if e == 3 else rng.uniform(0.02, 0.1)) for e in range(8)], "edge_id long, length double, speed double, lanes double, flow double")
    trips = [(t, 7.0 * t + rng.random()) for t in range(80)]
    routes = [(t, k, e) for t, _ in trips for k, e in enumerate([0, *rng.sample(range(1, 8), rng.randint(1, 5))])]
    departures, ways = spark.createDataFrame(trips, "trip_id long, departure double"), spark.createDataFrame(routes, "trip_id long, position int, edge_id long")
    one = {r.trip_id: tuple(r)[1:] for r in simulate_routes(departures, ways, edges).collect()}
    two = {r.trip_id: tuple(r)[1:] for r in simulate_events(departures, ways, edges).collect()}
    assert one.keys() == two.keys() and sum(x[2] for x in one.values()) > 1000
    assert all(one[t] == pytest.approx(two[t]) for t in one)


@pytest.mark.parametrize("chunk", [3.0, 50.0, 1e6])
def test_gates_by_stretches(spark, chunk):
    rng = random.Random(6)
    rows = [(rng.choice("abb"), float(rng.randint(0, 300)), k, rng.choice([0.0, 1.0, 4.0])) for k in range(300)]
    table = spark.createDataFrame(rows, "edge_id string, t double, position int, s double")
    got = {r.position: r.exit_time for r in gates.fifo_gate(table, "edge_id", "t", F.col("s"), chunk).collect()}
    free, want = {}, {}
    for e, t, k, s in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k] = max(t, free.get(e, 0.0))
        free[e] = want[k] + s
    assert got == pytest.approx(want)


def test_too_large_a_component_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(within_day, "MOST_LEGS", 2)
    edges = spark.createDataFrame([(0, 1.0, 1.0, 1.0, None)], "edge_id long, length double, speed double, lanes double, flow double")
    trips = spark.createDataFrame([(t, 0.0) for t in range(3)], "trip_id long, departure double")
    with pytest.raises(ValueError, match="more than one worker holds"):
        simulate_events(trips, trips.select("trip_id", F.lit(0).alias("position"), F.lit(0).cast("long").alias("edge_id")), edges)


def _events(edges, trips, routes, headway):
    """Times (trip, position) → (entry, arrival of the trip) of the event model."""
    ways = {}
    for t, k, e in routes:
        ways.setdefault(t, []).append(e)
    done = Simulation(edges).run([Trip(t, x, [Leg(0, Vehicle(headway), route=ways[t])]) for t, x in trips])
    return {(r.trip, k): at for r in done for k, (_, at) in enumerate(r.legs[0].route)} | {r.trip: r.arrival for r in done}


def test_rounds_with_full_roads_and_changing_gates(spark):
    """Speeds by occupied length and gates that change with time, some roads used by all: rounds against the event model."""
    rng = random.Random(8)
    times, flows = [0.0, 200.0, 400.0], [0.2031, 0.0307, 0.5113]  # no two times are equal
    kinds = {e: ("Bottleneck", "ThreeRegimes", "FreeFlow")[e % 3] for e in range(8)}
    lengths = {e: 150.0 + 17 * e + rng.random() for e in range(8)}

    def density(kind):
        def speed(base, occupied, total):
            if kind == "Bottleneck":
                return base if occupied <= 0.0937 * total / base else total / occupied * 0.0937
            share = (occupied / total - 0.05) / 0.35
            return base if share <= 0 else 2.0 if share >= 1 else min(base * (1 - share) + 2.0 * share, base)

        return None if kind == "FreeFlow" else speed

    def flow(t):
        return flows[max(sum(x <= t for x in times) - 1, 0)]

    trips = [(t, 4.0 * t + rng.random()) for t in range(100)]
    routes = [(t, k, e) for t, _ in trips for k, e in enumerate([0, *rng.sample(range(1, 8), rng.randint(1, 5))])]
    want = _events([Edge(e, lengths[e], 10.0, 1.0, flow if e in (0, 4) else None, density(kinds[e])) for e in range(8)], trips, routes, 12.0)
    table = spark.createDataFrame(routes, "trip_id long, position int, edge_id long").join(spark.createDataFrame(trips, "trip_id long, departure double"), "trip_id")
    table = table.join(spark.createDataFrame([(e, lengths[e], kinds[e]) for e in range(8)], "edge_id long, length double, kind string"), "edge_id")
    gated = F.col("edge_id").isin(0, 4)
    rows = table.withColumn("flow_times", F.when(gated, F.array(*map(F.lit, times))).otherwise(F.array(F.lit(0.0)))).withColumn("closings", F.when(gated, F.array(*[F.lit(1 / f) for f in flows])).otherwise(F.array(F.lit(0.0))))
    rows = rows.withColumns({"gap": F.lit(0.0), "spent": F.col("length") / 10.0, "closing": F.lit(0.0), "headway": F.lit(12.0), "wave": F.lit(0.0)})

    def spent_at(occupied):
        return F.col("length") / scalars.congested_speed(F.lit(10.0), occupied, F.col("length"), F.col("kind"), F.lit(0.0937), F.lit(0.05), F.lit(0.4), F.lit(2.0), F.lit(1.0))

    got = within_day.queue_steps(rows, spent_at=spent_at).collect()
    assert sum(r.spent > r.length / 10 + 1 for r in got) > 50 and sum(r.exit_time + r.entry_time - r.at_exit - r.reach_time > 1 for r in got) > 50
    assert all(r.entry_time == pytest.approx(want[r.trip_id, r.position]) for r in got)
    last = {}
    for r in got:
        last[r.trip_id] = max(last.get(r.trip_id, 0.0), r.exit_time)
    assert all(at == pytest.approx(want[t]) for t, at in last.items())


@pytest.mark.parametrize("stages", [1, 2, 4])
def test_gates_that_change_with_time(spark, stages):
    rng = random.Random(stages)
    times = sorted(rng.sample(range(0, 300), stages - 1) + [0])
    closing = {e: [rng.choice([0.0, 1.0, 4.0, 9.0]) for _ in times] for e in "abc"}
    rows = [(rng.choice("abb"), float(rng.randint(-20, 300)), k) for k in range(300)]
    table = spark.createDataFrame([(e, t, k, [float(x) for x in times], closing[e]) for e, t, k in rows], "edge_id string, t double, position int, times array<double>, closings array<double>")
    got = {r.position: r.exit_time for r in gates.fifo_gate_varying(table, "edge_id", "t", "times", "closings", stages).collect()}
    opens, want = {}, {}
    for e, t, k in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k] = max(t, opens.get(e, t))
        opens[e] = want[k] + closing[e][max(sum(x <= want[k] for x in times) - 1, 0)]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("held", "chunk"), [(False, 3.0), (True, None), (True, 3.0), (True, 50.0), (True, 1e6)])
def test_gates_held_by_those_before(spark, held, chunk):
    rng = random.Random(11)
    rows = [(rng.choice("abb"), float(rng.randint(0, 300)), k, rng.choice([0.0, 1.0, 4.0]), rng.choice([None, 0.0, 3.0, 40.0]) if held else None) for k in range(300)]
    rows = [(e, t, k, s, None if h is None else t + h) for e, t, k, s, h in rows]
    table = spark.createDataFrame(rows, "edge_id string, t double, position int, s double, until double")
    got = {r.position: r.exit_time for r in gates.fifo_gate(table, "edge_id", "t", F.col("s"), chunk, held="until").collect()}
    free, want = {}, {}
    for e, t, k, s, until in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k] = max(t, free.get(e, 0.0))
        free[e] = max(want[k] + s, until or 0.0)
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("full", "chunk"), [(False, None), (True, None), (False, 60.0)])
def test_rounds_without_overtaking(spark, full, chunk, monkeypatch):
    """Roads that merge into one another; vehicles of most cannot overtake at the exit: rounds against the event model."""
    rng = random.Random(12)
    lengths = {e: 150.0 + 17 * e + rng.random() for e in range(8)}
    flows = {e: None if e in (2, 5) else rng.uniform(0.05, 0.3) for e in range(8)}
    free = {3, 6}
    trips = [(t, 3.0 * t + rng.random()) for t in range(60)]
    routes = [(t, k, e) for t, _ in trips for k, e in enumerate([rng.choice([0, 1, 2]), rng.choice([3, 4]), 5, 6, 7][: rng.randint(2, 5)])]
    speed = (lambda base, occupied, total: base if occupied <= 0.0937 * total / base else total / occupied * 0.0937) if full else None
    listed = {may: [Edge(e, lengths[e], 10.0, 1.0, (lambda t, f=flows[e]: f) if flows[e] else None, speed if e == 4 else None, overtaking=may or e in free) for e in range(8)] for may in (False, True)}
    want, other = _events(listed[False], trips, routes, 12.0), _events(listed[True], trips, routes, 12.0)
    assert sum(abs(want[k] - other[k]) > 1 for k in want) > 20  # it matters here
    table = spark.createDataFrame(routes, "trip_id long, position int, edge_id long").join(spark.createDataFrame(trips, "trip_id long, departure double"), "trip_id")
    table = table.join(spark.createDataFrame([(e, lengths[e], 1 / flows[e] if flows[e] else 0.0, e not in free) for e in range(8)], "edge_id long, length double, closing double, ordered boolean"), "edge_id")
    rows = table.withColumns({"gap": F.lit(0.0), "spent": F.col("length") / 10.0, "headway": F.lit(12.0), "wave": F.lit(0.0)})
    if chunk:
        monkeypatch.setattr(within_day, "MOST_AT_GATE", 0)

    def spent_at(occupied):
        return F.col("length") / scalars.congested_speed(F.lit(10.0), occupied, F.col("length"), F.when(F.col("edge_id") == 4, "Bottleneck").otherwise("FreeFlow"), F.lit(0.0937), F.lit(0.05), F.lit(0.4), F.lit(2.0), F.lit(1.0))

    got = within_day.queue_steps(rows, spent_at=spent_at if full else None, **({"chunk": chunk} if chunk else {})).collect()
    assert all(r.entry_time == pytest.approx(want[r.trip_id, r.position]) for r in got)
    last = {}
    for r in got:
        last[r.trip_id] = max(last.get(r.trip_id, 0.0), r.exit_time)
    assert all(at == pytest.approx(want[t]) for t, at in last.items())
