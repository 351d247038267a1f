"""Labels of a network without small separators end before they fill the disk, and a search answers in their place."""

import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.operators import hubs
from wayfare.plans import routing_job, simulation
from wayfare.plans.parameters import RoadNetwork, SimulationParameters
from wayfare.sources.shared import cut

_N = 24


@pytest.fixture(scope="module")
def asked(spark):
    """A ring with chords whose times vary, and queries over it: every second one has a departure."""
    ends = [(k, (k + 1) % _N) for k in range(_N)] + [(k, (3 * k + 5) % _N) for k in range(_N) if (2 * k + 5) % _N and (2 * k + 4) % _N]
    rows = [(e, a, b, [float(60 + 10 * ((3 * e + 7 * k) % 11)) for k in range(25)]) for e, (a, b) in enumerate(ends)]
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, points array<double>")
    edges = cut(edges.select("edge_id", "source", "target", pwl.piecewise(F.lit(0.0), F.lit(3600.0), F.col("points")).cast(pwl.TYPE).alias("ttf")), "edges")
    queries = [(q, q % _N, (5 * q + 7) % _N, 1000.0 * q if q % 2 else None) for q in range(_N)]
    return edges, spark.createDataFrame(queries, "query_id long, origin long, destination long, departure_time double")


def _answers(queries, edges, algorithm):
    arrivals, profiles, taken = routing_job.answer(queries, edges, algorithm)
    points = {r.query_id: r.ttf.points or [r.ttf.cst] * 25 for r in profiles.collect()}
    return {r.query_id: r.arrival_time for r in arrivals.collect()}, points, taken


@pytest.mark.parametrize("algorithm", ["Intersect"])
def test_searched_for_where_labels_outgrow(asked, monkeypatch, algorithm):
    edges, queries = asked
    times, points, taken = _answers(queries, edges, algorithm)
    assert taken == algorithm and len(times) == len(points) == _N // 2
    monkeypatch.setattr(hubs, "MOST_POINTS", 2 * _N * hubs.LABEL_SIZE)
    fewer, searched, taken = _answers(queries, edges, algorithm)
    assert taken == "Dijkstra"
    assert fewer == pytest.approx(times)
    assert searched.keys() == points.keys() and all(searched[q] == pytest.approx(points[q]) for q in points)


def test_skims_where_labels_outgrow(asked, monkeypatch):
    edges, queries = asked
    p = SimulationParameters({}, (0.0, 86400.0), road_network=RoadNetwork(3600.0, spillback=False, algorithm_type="Intersect"))
    w = simulation.World(p, None, None, None, None, None)
    pairs = queries.select("origin", "destination").where("origin <> destination")
    whole = {(r.origin, r.destination): r.ttf.points for r in simulation.skims_of(w, pairs, edges).collect()}
    asked_for = []
    found = hubs.hub_labels
    monkeypatch.setattr(hubs, "MOST_POINTS", 2 * _N * hubs.LABEL_SIZE)
    monkeypatch.setattr(hubs, "hub_labels", lambda *a, **k: asked_for.append(found(*a, **k)) or asked_for[-1])
    got = {(r.origin, r.destination): r.ttf.points for r in simulation.skims_of(w, pairs, edges).collect()}
    assert asked_for == [None] and got.keys() == whole.keys()
    assert all(got[k] == pytest.approx(whole[k]) for k in whole)
