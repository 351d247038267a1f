"""Searches, hierarchies and their table forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.operators import routing
from wayfare.operators.graph import Graph, Grid, corridor
from wayfare.operators.hierarchy import Hierarchy


def grid_network(cost=1.0, special=None):
    edges = []
    for r in range(10):
        for col in range(10):
            n = 10 * r + col
            for m in ([n + 1] if col < 9 else []) + ([n + 10] if r < 9 else []):
                edges += [(len(edges), n, m, cost), (len(edges) + 1, m, n, cost)]
    if special is not None:
        edges[0] = (*edges[0][:3], special)
    return edges


def test_grid_is_manhattan():
    graph = Graph(grid_network())
    hierarchy = Hierarchy(graph)
    for a in range(0, 100, 7):
        reached, _ = graph.earliest(a, 0.0)
        for b in range(100):
            want = abs(a // 10 - b // 10) + abs(a % 10 - b % 10)
            assert reached[b] == want
            if b % 3 == 0:
                assert hierarchy.earliest(a, b, 0.0) == want


def test_time_dependent_edge():
    values = np.array([10.0, 15, 20, 15, 10])
    graph = Graph(grid_network(15.0, values), Grid(0, 2500, 5))
    assert graph.earliest_route(0, 11, 0.0)[0] == 25 and len(graph.earliest_route(0, 11, 0.0)[1]) == 2
    assert graph.earliest_route(0, 11, 5000.0)[0] == 5030
    arrival, route = graph.earliest_route(0, 99, 5000.0)
    assert arrival == 5270 and len(route) == 18 and 0 not in route
    profile = graph.profile(0, {11})[11]
    for k, x in enumerate(graph.grid.xs):
        assert profile[k] == pytest.approx(graph.earliest_route(0, 11, x)[0] - x)
    assert Hierarchy(graph).profile(0, 11) == pytest.approx(profile)
    assert graph.reversed_profile(11)[0] == pytest.approx(profile)


def test_unreachable_and_bad_order():
    graph = Graph([(1, 1, 2, 1.0), (2, 2, 3, 2.0), (3, 3, 4, 1.0), (4, 2, 4, 9.0), (5, 4, 5, 1.0), (6, 9, 1, np.inf)])
    order = {2: 0, 3: 1, 4: 2, 1: 3, 5: 4, 9: 5}
    hierarchy = Hierarchy(graph, order)
    assert hierarchy.earliest(1, 5, 0.0) == 5 and hierarchy.earliest(5, 1, 0.0) is None and graph.earliest_route(9, 1, 0.0) is None
    assert graph.earliest_route(1, 5, 0.0)[1] == [1, 2, 3, 5]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(e, s, t, float(c)) for e, s, t, c in grid_network(15.0)]
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, travel_time double").where("source < 40 and target < 40")
    special = F.when(F.col("edge_id") == 0, pwl.piecewise(F.lit(0.0), F.lit(2500.0), F.lit([10.0, 15.0, 20.0, 15.0, 10.0]))).otherwise(pwl.constant(F.col("travel_time")))
    return edges.select("edge_id", "source", "target", special.cast(pwl.TYPE).alias("ttf"))


def test_strategies_agree(spark, tables):
    queries = spark.createDataFrame([(i, i % 7, 39 - i % 11, 500.0 * i) for i in range(20)] + [(20, 3, 3, 5.0)], "query_id long, origin long, destination long, departure_time double")
    direct = {r.query_id: r.arrival_time for r in routing.earliest_arrivals(queries, tables).collect()}
    forward = routing.search_spaces(queries.select(F.col("origin").alias("node")), tables, True)
    backward = routing.search_spaces(queries.select(F.col("destination").alias("node")), tables, False)
    hubs = {r.query_id: r.arrival_time for r in routing.intersect_arrivals(queries, forward, backward).collect()}
    assert hubs == pytest.approx(direct) and direct[20] == 5
    pairs = queries.select("origin", "destination").distinct()
    a = {(r.origin, r.destination): r.ttf for r in routing.profiles(pairs, tables).collect()}
    c = {(r.origin, r.destination): r.ttf for r in routing.hierarchy_profiles(pairs, tables, routing.build_hierarchy(tables)).collect()}
    assert {k: f.points or f.cst for k, f in c.items()} == {k: pytest.approx(f.points or f.cst) for k, f in a.items()}
    b = {(r.origin, r.destination): r.ttf for r in routing.intersect_profiles(pairs, forward, backward).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k].points is None) == (b[k].points is None) and (a[k].points or [a[k].cst]) == pytest.approx(b[k].points or [b[k].cst])


def test_rounds_of_joins(spark, tables):
    starts = spark.createDataFrame([(1, 0, 5000.0)], "query_id long, node long, arrival_time double")
    got = {r.node: r.arrival_time for r in routing.relax(starts, tables.where("source < 30 and target < 30")).collect()}
    assert got[11] == 5030 and len(got) == 30


def test_algorithm_choice():
    assert routing.algorithm(100, 100, 100, 100) == "Dijkstra" and routing.algorithm(1000, 2, 2, 100) == "Intersect" and routing.algorithm(1000, 3, 2, 100) == "TCH"
    assert routing.algorithm(5, 10, 10, 100, simulator=True) == "Intersect"


def test_many_sources_bounds_and_hops():
    graph = Graph(grid_network())
    reached, _ = graph.earliest_from({0: 0.0, 99: 5.0})
    assert reached[98] == 6 and reached[1] == 1
    assert set(graph.earliest_from({0: 0.0}, bound=2.5)[0]) == {0, 1, 10, 2, 11, 20}
    assert set(graph.earliest_from({0: 0.0}, hops=1)[0]) == {0, 1, 10}


def random_graph(seed, nodes=24, grid=None):
    rng = np.random.default_rng(seed)
    edges = []
    for n in range(nodes):
        for m in rng.choice(nodes, 3, replace=False).tolist():
            if m != n:
                f = float(rng.integers(5, 60))
                if grid is not None and rng.random() < 0.5:
                    f = np.maximum(f + rng.uniform(-1, 1, grid.size).cumsum(), 1.0)  # slopes above -1: first in, first out
                edges.append((len(edges), n, m, f))
    return Graph(edges, grid)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("grid", [None, Grid(0.0, 40.0, 12)])
def test_hierarchy_gives_the_routes_of_plain_searches(seed, grid):
    graph = random_graph(seed, grid=grid)
    hierarchy = Hierarchy(graph)
    given = Hierarchy(graph, {n: (n * 7) % 24 for n in graph.nodes})
    assert sorted(hierarchy.order.values()) == list(range(len(graph.nodes))) and hierarchy.edges >= 0
    assert [n for n, _ in sorted(given.order.items(), key=lambda x: x[1])] == sorted(graph.nodes, key=lambda n: (n * 7) % 24)
    for a in range(0, 24, 5):
        for b in range(24):
            for t in (0.0, 130.0, 333.0):
                want = graph.earliest_route(a, b, t)
                for h in (hierarchy, given):
                    got = h.earliest_route(a, b, t)
                    assert (got is None) == (want is None)
                    if want is None:
                        continue
                    at, nodes = t, [a]
                    for e in got[1]:  # the route is one, without loops, and takes as long as it says
                        assert next((s, m) for s, ways in graph.out.items() for x, m in ways if x == e)[0] == nodes[-1]
                        at += graph.evaluate(graph.functions[e], at)
                        nodes.append(h._target[e])
                    assert nodes[-1] == b and len(set(nodes)) == len(nodes) and at == pytest.approx(got[0])
                    assert got[0] == pytest.approx(want[0], rel=1e-9 if grid is None else 2e-2)
            whole = graph.profile(a, {b}).get(b)
            for other in (hierarchy.profile(a, b), given.profile(a, b), graph.two_way_profile(a, b)):
                assert (whole is None) == (other is None)
                if whole is not None:
                    assert np.asarray(other) + np.zeros(12) == pytest.approx(np.asarray(whole) + np.zeros(12), rel=1e-9 if grid is None else 2e-2)
            bounds = hierarchy.interval(a, b)
            if whole is not None:
                assert bounds[0] <= np.min(whole) * 1.02 and bounds[1] >= np.max(whole) * 0.98  # links on a grid are rounded
            if grid is None:
                two = graph.two_way(a, b)
                assert (two is None) == (whole is None)
                if two is not None:
                    assert two[0] == pytest.approx(graph.earliest_route(a, b, 0.0)[0]) and sum(graph.functions[e] for e in two[1]) == pytest.approx(two[0])


@pytest.mark.parametrize("seed", range(3))
def test_intervals_hold_the_profiles(seed):
    graph = random_graph(seed, grid=Grid(0.0, 40.0, 12))
    profiles, (bounds, before) = graph.profile(0), graph.intervals(0)
    back, _ = graph.intervals(0, forward=False)
    assert profiles.keys() == bounds.keys() and back[0] == (0.0, 0.0)
    for n, f in profiles.items():
        assert bounds[n][0] <= np.min(f) + 1e-9 and bounds[n][1] >= np.max(f) - 1e-9 and len(before[n]) <= 2
        assert {0, n} <= corridor(before, n)
    near, _ = graph.intervals(0, hops=1)
    assert set(near) == {0, *(m for _, m in graph.out[0])}
    assert 1 not in graph.intervals(0, without=1)[0]


@pytest.mark.parametrize("most", [256 << 20, 0])
def test_routes_on_both_sides_of_the_bound(spark, tables, monkeypatch, most):
    monkeypatch.setattr(routing, "MOST_BYTES", most)
    cut_off = spark.createDataFrame([(900, 77, 78)], "edge_id long, source long, target long").withColumn("ttf", pwl.constant(F.lit(1.0)).cast(pwl.TYPE))
    edges = tables.unionByName(cut_off)
    queries = spark.createDataFrame([(1, 0, 1, 5000.0), (2, 0, 39, 0.0), (3, 3, 3, 5.0), (4, 0, 78, 0.0), (5, 77, 78, 0.0), (6, 39, 0, 100.0)], "query_id long, origin long, destination long, departure_time double")
    got = {r.query_id: r for r in routing.earliest_arrivals(queries, edges).collect()}
    assert got[1].arrival_time == 5020 and got[1].route == [0] and got[3].route == [] and got[3].arrival_time == 5
    assert got[4].arrival_time is None and got[4].route is None and got[5].route == [900]
    held = {r.edge_id: (r.source, r.target) for r in edges.collect()}
    for k, hops in ((2, 12), (6, 12)):
        ends = [held[e] for e in got[k].route]
        assert len(ends) == hops and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert {k: r.arrival_time for k, r in got.items()} == {1: 5020, 2: 12 * 15 - 5, 3: 5, 4: None, 5: 1, 6: 100 + 12 * 15}


def test_hierarchy_answers_tables(spark, tables):
    queries = spark.createDataFrame([(i, i % 7, 39 - i % 11, 500.0 * i) for i in range(20)] + [(20, 3, 3, 5.0), (21, 3, 1000, 0.0)], "query_id long, origin long, destination long, departure_time double")
    hierarchy = routing.build_hierarchy(tables)
    one = {r.query_id: r for r in routing.earliest_arrivals(queries, tables).collect()}
    two = {r.query_id: r for r in routing.hierarchy_arrivals(queries, tables, hierarchy).collect()}
    assert {k: r.arrival_time for k, r in one.items()} == pytest.approx({k: r.arrival_time for k, r in two.items()}, nan_ok=True)
    assert all((r.route is None) == (two[k].route is None) and (r.route is None or len(r.route) == len(two[k].route)) for k, r in one.items())
