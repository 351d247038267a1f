"""Hand-computed timings of small networks."""

from wayfare.streaming.supply import Edge, Leg, Simulation, Trip, Vehicle


def _run(edges, trips, **options):
    simulation = Simulation(edges, **options)
    results = simulation.run(trips)
    return [r.arrival for r in results], [r.legs[0] for r in results]


def _bottleneck(overtaking):
    edges = [Edge(0, 1, 1, flow=lambda t: 0.5, overtaking=overtaking), Edge(1, 1, 1, flow=lambda t: 0.25, overtaking=overtaking)]
    trips = [Trip(i, t, [Leg(1, Vehicle(1), route=[0, 1])]) for i, t in enumerate([0, 3, 4, 5, 10, 21])]
    return _run(edges, trips)


def test_bottleneck_without_overtaking():
    arrivals, legs = _bottleneck(False)
    assert arrivals == [2, 6, 10, 14, 18, 23]
    assert [x.in_bottleneck for x in legs] == [0, 1, 3, 4, 2, 0]
    assert [x.out_bottleneck for x in legs] == [0, 0, 1, 3, 4, 0]
    assert [x.road_time for x in legs] == [2] * 6


def test_bottleneck_with_overtaking():
    arrivals, legs = _bottleneck(True)
    assert arrivals == [2, 6, 10, 14, 18, 23]
    assert [x.in_bottleneck for x in legs] == [0, 1, 4, 7, 6, 0]
    assert [x.out_bottleneck for x in legs] == [0] * 6


def test_spillback():
    edges = [Edge(0, 10, 1), Edge(1, 10, 1)]
    starts = [(0, 0), (7, 1), (5, 0), (6, 0), (9, 0), (30, 0)]
    trips = [Trip(i, t, [Leg(1, Vehicle(6), route=[0, 1][o:])]) for i, (t, o) in enumerate(starts)]
    arrivals, legs = _run(edges, trips, spillback=True, max_pending=1000)
    assert arrivals == [20, 17, 27, 30, 37, 50]
    assert [x.in_bottleneck for x in legs] == [0, 0, 2, 4, 8, 0]
    assert [x.road_time for x in legs] == [20, 10, 20, 20, 20, 20]


def test_gridlock():
    edges = [Edge(i, 5, 1) for i in range(4)]
    routes = [[0, 1, 2], [1, 2, 3], [2, 3, 0], [3, 0, 1]]
    trips = [Trip(i, t, [Leg(1, Vehicle(6), route=r)]) for i, (t, r) in enumerate(zip([0, 2, 1, 3], routes))]
    arrivals, legs = _run(edges, trips, spillback=True, max_pending=10)
    assert arrivals == [25] * 4
    assert [x.in_bottleneck for x in legs] == [10, 8, 9, 7]
    assert [x.road_time for x in legs] == [15] * 4


def test_legs():
    edges = [Edge(0, 1, 1), Edge(1, 2, 1)]
    half = Vehicle(1, speed=lambda s: s * 0.5)
    ttf = lambda t: min(t, 10) if t <= 10 else 10 - (t - 10) / 2
    legs = [Leg(1, Vehicle(1), route=[0], stopping=2), Leg(2, travel_time=ttf, stopping=1), Leg(3, half, route=[1], stopping=1), Leg(4, half, origin=2, destination=2)]
    result = Simulation(edges).run([Trip(0, 0, legs, origin_delay=3)])[0]
    assert result.arrival == 18
    assert [(x.departure, x.arrival) for x in result.legs] == [(3, 4), (6, 12), (13, 17), (18, 18)]
