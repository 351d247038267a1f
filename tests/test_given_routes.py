"""A day whose road legs all have their routes: expected by a fold over tables, with no graph on the driver or in a worker."""

import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.operators import routing
from wayfare.plans import catalogue_day, simulation
from wayfare.sources.shared import cut

_SMALL = "/root/testdata/sf0.001"


def test_course_of_given_routes(spark):
    w = catalogue_day._world(spark, _SMALL)
    flat = simulation.initial_weights(spark, w, simulation.free_flow(w))
    assert simulation._graphs(w, flat) == {}
    swing = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.col("ttf.cst") + (F.col("edge_id") * 3 + k * 7) % 11 * 40.0)
    weights = cut(flat.select("uvehicle", "edge_id", F.when(F.col("edge_id") % 3 > 0, pwl.piecewise(F.lit(0.0), F.lit(3600.0), swing)).otherwise(F.col("ttf")).cast(pwl.TYPE).alias("ttf")), "weights")
    ends = w.edges.select("edge_id", "source", "target")
    graphs = {u: routing.load_graph(weights.where(F.col("uvehicle") == u).join(ends, "edge_id")) for u in (0, 1)}
    legs = w.legs.join(w.vehicles.select(F.col("vehicle_id").alias("class_vehicle"), "uvehicle"), "class_vehicle", "left")
    starts = w.alternatives.where("dt_choice_type = 'Constant'").select("agent_id", "alt_id", F.col("dt_choice_departure_time").alias("departure"))
    trips = simulation._trips_to_walk(w, legs, starts)
    want, got = ({(r.agent_id, r.alt_id, r.trip_index): r for r in simulation.walk(w, trips, weights, g).collect()} for g in (graphs, {}))
    assert got.keys() == want.keys() and len(got) > 2
    for k, r in want.items():
        assert (got[k].leg_departure, got[k].leg_arrival) == pytest.approx((r.leg_departure, r.leg_arrival))
        assert got[k].leg_route == r.leg_route
    closed = weights.where("edge_id % 2 > 0")
    with pytest.raises(Exception, match="may not"):
        simulation.walk(w, trips, closed, {}).collect()
