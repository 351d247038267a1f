"""Edges whose speed falls with the vehicles on them: each is done once, and has the times of the rounds."""

import random

import pytest
from pyspark.sql import functions as F

from wayfare.functions import scalars
from wayfare.plans import within_day

KINDS = ("FreeFlow", "Bottleneck", "ThreeRegimes")


def _world(spark, routes):
    rng = random.Random(3)
    columns = "edge_id long, length double, speed double, lanes double, speed_density_type string, speed_density_capacity double, speed_density_min_density double, speed_density_jam_density double, speed_density_jam_speed double, speed_density_beta double"
    edges = spark.createDataFrame([(e, 300.0 + 17 * e + rng.random(), 10.0 + e % 3, 1.0, KINDS[e % 3], 0.02, 0.05, 0.4, 2.0, 1.5) for e in range(6)], columns)
    departures = spark.createDataFrame([(t, 2.0 * t + rng.random()) for t in range(60)], "trip_id long, departure double")
    ways = spark.createDataFrame([(t, k, e) for t in range(60) for k, e in enumerate(routes(t))], "trip_id long, position int, edge_id long")
    return departures, ways, edges


def _by_rounds(departures, ways, edges, headway):
    rows = ways.join(edges, "edge_id").join(departures, "trip_id").withColumns({"gap": F.lit(0.0), "spent": F.col("length") / F.col("speed"), "closing": F.lit(0.0), "headway": F.lit(headway), "wave": F.col("length") / 5.0})

    def spent_at(occupied):
        return F.col("length") / scalars.congested_speed(F.col("speed"), occupied, F.col("length") * F.col("lanes"), *[F.col(c) for c in within_day._DENSITY])

    return {(r.trip_id, r.position): (r.entry_time, r.exit_time) for r in within_day.queue_steps(rows, spent_at=spent_at).collect()}


@pytest.mark.parametrize("routes", [lambda t: [0, 1, 2, 3, 4, 5][: 2 + t % 5], lambda t: [(t + k) % 6 for k in range(4)]], ids=["line", "ring"])
def test_dense_edges_have_the_times_of_the_rounds(spark, routes):
    departures, ways, edges = _world(spark, routes)
    got = {(r.trip_id, r.position): (r.entry_time, r.exit_time) for r in within_day.dense_network(departures, ways, edges, 20.0, 5.0).collect()}
    want = _by_rounds(departures, ways, edges, 20.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    free = {r.edge_id: r.length / r.speed for r in edges.collect()}
    assert sum(got[r.trip_id, r.position][1] - got[r.trip_id, r.position][0] > free[r.edge_id] + 1 for r in ways.collect()) > 20


def test_dense_edges_on_a_line_are_not_done_by_rounds(spark, monkeypatch):
    """No leg is written more often than once and a hop ahead; a road that the network does not have passes at once."""
    departures, ways, edges = _world(spark, lambda t: [0, 1, 99, 2, 3][: 2 + t % 4])
    written, cut = [], within_day.cut
    monkeypatch.setattr(within_day, "queue_steps", None)
    monkeypatch.setattr(within_day, "cut", lambda df, label: (out := cut(df, label), label == "queue" and written.append(out.count()))[0])
    rows = within_day.dense_network(departures, ways, edges, 20.0).collect()
    at = {(r.trip_id, r.position): r for r in rows}
    assert len(at) == ways.where("edge_id <> 99").count() and sum(written) <= ways.count()
    assert all(at[t, 3].entry_time == at[t, 1].exit_time for t, k in at if k == 3)
