"""Searches by rounds of joins and hub labels against plain searches on random networks of hourly functions."""

import random

import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.operators import hubs, rounds, routing


@pytest.fixture(scope="module")
def network(spark):
    """Fourteen nodes by name, some edges parallel, constant or closed, one node that cannot be left and one that cannot be reached."""
    rng = random.Random(12)
    names = [f"n{k}" for k in range(14)]
    rows = []
    for e in range(40):
        a, b = rng.sample(names[1:13], 2)
        points = [float(rng.randint(20, 400)) for _ in range(6)] if e % 4 else None
        rows.append((e, a, b, points, None if points else (float("inf") if e == 8 else float(rng.randint(20, 400)))))
    rows += [(40, "n1", "n0", None, 30.0), (41, "n13", "n1", None, 30.0)]
    table = spark.createDataFrame(rows, "edge_id long, source string, target string, points array<double>, cst double")
    ttf = F.when(F.col("points").isNull(), pwl.constant(F.col("cst"))).otherwise(pwl.piecewise(F.lit(0.0), F.lit(600.0), F.col("points"))).cast(pwl.TYPE)
    edges = rounds.cut(table.select("edge_id", "source", "target", ttf.alias("ttf")), "edges")
    queries = [(q, rng.choice(names), rng.choice(names), rng.uniform(-100, 4000)) for q in range(60)] + [(60, "n0", "n5", 0.0), (61, "n3", "n13", 0.0), (62, "n4", "n4", 77.0)]
    return edges, routing.load_graph(edges), queries, spark.createDataFrame(queries, "query_id long, origin string, destination string, departure_time double")


def test_arrivals_and_routes(network):
    edges, graph, queries, table = network
    got = {r.query_id: r for r in rounds.arrivals_by_rounds(table, edges, True).collect()}
    assert len(got) == len(queries)
    ends = {r.edge_id: (r.source, r.target) for r in edges.collect()}
    for q, a, b, t in queries:
        found = graph.earliest_route(a, b, t)
        assert (got[q].arrival_time is None) == (found is None) == (got[q].route is None)
        if found:
            at, place = t, a
            for e in got[q].route:
                assert ends[e][0] == place
                at, place = at + graph.evaluate(graph.functions[e], at), ends[e][1]
            assert place == b and at == pytest.approx(found[0]) == pytest.approx(got[q].arrival_time)


@pytest.mark.parametrize("given", [False, True])
def test_hub_labels(spark, network, given):
    edges, graph, queries, table = network
    order = spark.createDataFrame([(f"n{k}", (k * 5) % 14) for k in range(14)], "node_id string, order long") if given else hubs.node_order(edges)
    assert sorted(r.order for r in order.collect()) == list(range(14))
    labels = rounds.cut(hubs.hub_labels(edges, order if given else None), "labels")
    got = {r.query_id: r.arrival_time for r in hubs.hub_arrivals(table, labels).collect()}
    for q, a, b, t in queries:
        found = graph.earliest_route(a, b, t)
        assert (q in got) == (found is not None)
        assert found is None or got[q] == pytest.approx(found[0])
    if not given:
        pairs = table.select("origin", "destination").distinct()
        one = {(r.origin, r.destination): r.ttf for r in hubs.hub_profiles(pairs, labels, hubs.grid_of(edges)).collect()}
        two = {(r.origin, r.destination): r.ttf for r in rounds.profiles_by_rounds(pairs, edges).collect()}
        for (a, b), f in two.items():
            xs = [600.0 * k for k in range(6)]
            want = [graph.earliest_route(a, b, x) for x in xs]
            assert (f is None) == (want[0] is None) == ((a, b) not in one)
            for g in (f, one.get((a, b))) if f is not None else ():
                values = g.points or [g.cst] * 6
                assert values == pytest.approx([w[0] - x for w, x in zip(want, xs, strict=True)])
