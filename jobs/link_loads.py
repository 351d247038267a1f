"""Batch job: a day's trips through the queues of the network, to the loads of every road by hour.

    python jobs/link_loads.py --tables FOLDER --output FOLDER [--config FILE] [--period SECONDS] [--constrain-inflow true|false]

Reads trips (``orders`` with ``customer``), their routes (``lineitem``) and the roads (``supplier``, ``nation``), finds when each trip enters and leaves
each road of its route by the library's rounds of window functions, and writes ``loads``, partitioned by hour (period of the entry): vehicles that
enter, their mean and longest wait at the gates, their mean travel time, and vehicle hours.  A run replaces the whole table, so that running again gives the same.

Trips without a route use no road.  Steps of a route beyond the network's roads are left out; the log says how many there are and names the first ten roads.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.plans import derived
from wayfare.plans.within_day import queue_network

log = logging.getLogger("jobs.link_loads")

LOADS = "edge_id long, vehicles long, mean_wait double, longest_wait double, mean_time double, vehicle_hours double, hour long"


def loads(steps: DataFrame, period: float) -> DataFrame:
    """Loads of each road and period from the times of all trips on it."""
    wait = F.col("entry_time") - F.col("reach_time") + F.col("exit_time") - F.col("at_exit")
    spent = F.col("exit_time") - F.col("reach_time")
    grouped = steps.groupBy("edge_id", F.floor(F.col("entry_time") / period).cast("long").alias("hour"))
    summed = grouped.agg(F.count("*").alias("vehicles"), F.avg(wait).alias("mean_wait"), F.max(wait).alias("longest_wait"), F.avg(spent).alias("mean_time"), (F.sum(spent) / 3600).alias("vehicle_hours"))
    return summed.select("edge_id", "vehicles", "mean_wait", "longest_wait", "mean_time", "vehicle_hours", "hour")


def run(spark: SparkSession, tables: str, output: str, period: float = 3600.0, constrain_inflow: bool = True) -> DataFrame:
    """Writes and returns the loads, read back."""
    made = f"{output.rstrip('/')}/loads"
    routes, edges = derived.frame(spark, tables, derived.LAYER_ROUTES), derived.frame(spark, tables, derived.LAYER_EDGES)
    # a part of a second by trip, so that no two come to a gate at one time
    departures = derived.frame(spark, tables, derived.TRIPS).select("trip_id", (F.col("departure") + F.col("trip_id") % 8191 / 8191).alias("departure"))
    unknown = routes.join(edges, "edge_id", "left_anti")
    left_out = unknown.count()
    if left_out:
        first = [r.edge_id for r in unknown.select("edge_id").distinct().orderBy("edge_id").limit(10).collect()]
        log.warning("%s steps are over roads that the network does not have and are left out, the first of these roads: %s", left_out, first)
    steps = queue_network(departures, routes, edges, constrain_inflow)
    log.info("%s: %s trips, %s steps on %s roads read", tables, departures.count(), routes.count(), edges.count())
    loads(steps, float(period)).repartition("hour").write.mode("overwrite").partitionBy("hour").parquet(made)
    written = spark.read.schema(LOADS).parquet(made)
    log.info("%s: %s rows written", made, written.count())
    return written


if __name__ == "__main__":
    from jobs import command
    from jobs.link_loads import run as job

    sys.exit(command.main(job, os.path.join(os.path.dirname(os.path.abspath(__file__)), "link_loads.json"), ("tables", "output")))
