"""Work that must grow no faster than its input."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.operators import network, routing
from wayfare.operators.graph import Graph, Grid
from wayfare.operators.hierarchy import Hierarchy
from wayfare.plans import within_day
from wayfare.sources import shared


def test_access_of_more_vehicles_than_a_list_holds(spark):
    """Some 12,000 vehicles: totals by restricted and allowed lists are those of the rows, which have no limit on vehicles either."""
    edges = spark.range(4).select(F.col("id").alias("edge_id"))
    ids = spark.range(12_000).select(F.col("id").alias("vehicle_id"))
    allowed = F.when(F.col("vehicle_id") % 3 == 0, F.array(F.lit(1), F.lit(1), F.lit(9))).cast("array<long>")
    restricted = F.when(F.col("vehicle_id") % 3 == 1, F.array(F.col("vehicle_id") % 5, F.col("vehicle_id") % 5)).when(F.col("vehicle_id") == 2, F.array(*[F.lit(k).cast("long") for k in range(4)]))
    vehicles = ids.select("vehicle_id", allowed.alias("allowed_edges"), restricted.alias("restricted_edges"))
    rows = network.accessible_edges(vehicles, edges).groupBy("vehicle_id").agg(F.count("*").alias("edges"), F.sum("edge_id").alias("edge_sum"))
    want, got = (df.toPandas().sort_values("vehicle_id").reset_index(drop=True) for df in (rows, network.access_totals(vehicles, edges)))
    pd.testing.assert_frame_equal(got, want)
    assert len(want) == 11_999  # vehicle 2 may use none


def test_each_leg_is_done_once_where_ways_do_not_go_round(spark, monkeypatch):
    """Trips down a line of six narrow roads, entering anywhere: the queues write no leg more often than the line is long, and mostly once."""
    written = []

    def counted(df, label="table"):
        out = cut(df, label)
        if label == "queue":
            written.append(out.count())
        return out

    cut = within_day.cut
    monkeypatch.setattr(within_day, "cut", counted)
    edges = spark.createDataFrame([(e, 100.0 + e, 10.0, 1.0, 0.05 + 0.01 * (e % 3)) for e in range(6)], "edge_id long, length double, speed double, lanes double, flow double")
    departures = spark.createDataFrame([(t, 3.0 * t + t % 7 / 7) for t in range(60)], "trip_id long, departure double")
    ways = spark.createDataFrame([(t, k, e) for t in range(60) for k, e in enumerate([0, 1, 2, 3, 99, 4, 5][: 2 + t % 6])], "trip_id long, position int, edge_id long")
    got = {(r.trip_id, r.position): r.exit_time for r in within_day.queue_network(departures, ways, edges).collect()}
    legs = ways.count()
    assert sum(written) <= legs
    rows = ways.join(edges, "edge_id").join(departures, "trip_id").select("trip_id", "position", "edge_id", "departure", F.lit(0.0).alias("gap"), (F.col("length") / F.col("speed")).alias("spent"), (1 / (F.col("flow") * F.col("lanes"))).alias("closing"))
    want = {(r.trip_id, r.position): r.exit_time for r in within_day.queue_steps(rows).collect()}
    assert got == pytest.approx(want)


def test_few_small_searches_are_dealt_over_all_tasks(spark):
    edges = spark.createDataFrame([(k, k % 40, (k + 1) % 40) for k in range(40)], "edge_id long, source long, target long").withColumn("ttf", pwl.constant(F.lit(2.0)).cast(pwl.TYPE))
    origins = spark.range(40).select(F.col("id").alias("origin"), F.col("id").alias("query_id"), (39 - F.col("id")).alias("destination"), F.lit(0.0).alias("departure_time")).coalesce(1)
    for got in (routing.interval_bounds(origins, edges), routing.one_to_all(origins, edges), routing.earliest_arrivals(origins, edges), routing.profiles(origins, edges)):
        assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_a_large_hierarchy_keeps_its_core_together():
    """150 nodes joined at random: nodes with many ways are not contracted, and routes, arrivals, profiles and spaces are those of plain searches."""
    rng, grid = random.Random(3), Grid(0.0, 3600.0, 5)
    edges = [(k, k % 150, (k + 1) % 150 if k < 150 else rng.randrange(150), rng.uniform(10, 99) if k % 3 else np.array([rng.uniform(10, 99) for _ in range(5)])) for k in range(450)]
    graph = Graph([e for e in edges if e[1] != e[2]], grid)
    for g in (Graph([(e, s, t, float(np.min(f))) for e, s, t, f in edges if s != t]), graph):
        h = Hierarchy(g)
        assert 0 < h.rim < 150 and sorted(h.order.values()) == list(range(150))
        for o, t in ((rng.randrange(150), rng.randrange(150)) for _ in range(25)):
            if g is graph:
                continue  # over varying functions the ways are off between grid points, as the README says
            assert h.earliest_route(o, t, 0.0)[0] == pytest.approx(g.earliest_route(o, t, 0.0)[0])
            assert h.profile(o, t) == pytest.approx(g.profile(o, {t})[t])
            up, down = h.forward_space(o), h.backward_space(t)
            assert min(up[x] + down[x] for x in up.keys() & down.keys()) == pytest.approx(g.profile(o, {t})[t])
            assert h.interval(o, t) == pytest.approx((g.profile(o, {t})[t],) * 2)


def test_rounds_leave_one_table(spark):
    """Of the tables of all rounds of a queue only the last one is left under the checkpoint folder."""
    folder = shared.shared_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder))
    rows = spark.createDataFrame([(t, k, k % 2, float(t), 0.0, 5.0, 4.0) for t in range(20) for k in range(4)], "trip_id long, position int, edge_id long, departure double, gap double, spent double, closing double")
    got = within_day.queue_steps(rows)
    assert got.count() == 80
    assert len({f for f in os.listdir(folder) if f.startswith("queue-")} - before) == 1
