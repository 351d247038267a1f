"""Summaries of an iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import pwl


def distribution(value: Column, name: str) -> list[Column]:
    """name_mean, name_std (of the population), name_min, name_max; nulls are skipped."""
    return [F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_std"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def trip_aggregates(agents: DataFrame) -> list[Column]:
    """Columns over agents with a trip alternative: count, distributions, absolute shifts."""
    d = distribution
    shift = F.abs(F.col("departure_time_shift"))
    return [
        F.count("*").alias("trip_alt_count"),
        *d(F.col("departure_time"), "alt_departure_time"),
        *d(F.col("arrival_time"), "alt_arrival_time"),
        *d(F.col("total_travel_time"), "alt_travel_time"),
        *d(F.col("utility"), "alt_utility"),
        *d(F.col("alt_expected_utility"), "alt_expected_utility"),
        *d(shift, "alt_dep_time_shift"),
        F.sqrt(F.avg(shift * shift)).alias("alt_dep_time_rmse"),
    ]


def road_trip_aggregates(trips: DataFrame) -> DataFrame:
    """One row over road trips."""
    from wayfare.functions import scalars

    d, c = distribution, F.col
    spent = c("arrival_time") - c("departure_time")
    expected = c("exp_arrival_time") - c("departure_time")
    return trips.agg(
        F.count("*").alias("road_trip_count"),
        *d(c("departure_time"), "road_trip_departure_time"),
        *d(c("arrival_time"), "road_trip_arrival_time"),
        *d(c("road_time"), "road_trip_road_time"),
        *d(c("in_bottleneck_time"), "road_trip_in_bottleneck_time"),
        *d(c("out_bottleneck_time"), "road_trip_out_bottleneck_time"),
        *d(spent, "road_trip_travel_time"),
        *d(c("route_free_flow_travel_time"), "road_trip_route_free_flow_travel_time"),
        *d(c("global_free_flow_travel_time"), "road_trip_global_free_flow_travel_time"),
        *d(scalars.congestion(spent, c("route_free_flow_travel_time")), "road_trip_route_congestion"),
        *d(scalars.congestion(spent, c("global_free_flow_travel_time")), "road_trip_global_congestion"),
        *d(c("length"), "road_trip_length"),
        *d(c("nb_edges"), "road_trip_edge_count"),
        *d(c("travel_utility") + c("schedule_utility"), "road_trip_utility"),
        *d(expected, "road_trip_exp_travel_time"),
        *d(scalars.relative_difference(spent, expected), "road_trip_exp_travel_time_rel_diff"),
        *d(F.abs(spent - expected), "road_trip_exp_travel_time_abs_diff"),
        rmse(spent, expected).alias("road_trip_exp_travel_time_diff_rmse"),
        *d(c("length_diff"), "road_trip_length_diff"),
    )


def virtual_trip_aggregates(trips: DataFrame) -> DataFrame:
    """One row over virtual trips."""
    from wayfare.functions import scalars

    d, c = distribution, F.col
    spent = c("arrival_time") - c("departure_time")
    return trips.agg(
        F.count("*").alias("virtual_trip_count"),
        *d(c("departure_time"), "virtual_trip_departure_time"),
        *d(c("arrival_time"), "virtual_trip_arrival_time"),
        *d(spent, "virtual_trip_travel_time"),
        *d(c("global_free_flow_travel_time"), "virtual_trip_global_free_flow_travel_time"),
        *d(scalars.congestion(spent, c("global_free_flow_travel_time")), "virtual_trip_global_congestion"),
        *d(c("travel_utility") + c("schedule_utility"), "virtual_trip_utility"),
    )


def by_agent(trips: DataFrame, name: str) -> DataFrame:
    """Trips of a class per agent: agents with one at least, and the distribution of their number."""
    n = trips.groupBy("agent_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias(f"nb_agents_at_least_one_{name}"), *distribution(F.col("n"), f"{name}_count_by_agent"))


def histogram(values: DataFrame, x: str, start: float, end: float, bins: int = 128) -> DataFrame:
    """bin (from 0), bin_start, bin_end, count: bins closed on the right, the first one on both sides.

    The range is the given one widened to the values; their ends are one row, joined back to the values.
    """
    ends = values.agg(F.least(F.min(x), F.lit(float(start))).alias("lo"), F.greatest(F.max(x), F.lit(float(end))).alias("hi"))
    ends = ends.select(F.coalesce("lo", F.lit(float(start))).alias("lo"), F.coalesce("hi", F.lit(float(end))).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.greatest(F.ceil((F.col(x) - F.col("lo")) / width), F.lit(1)), F.lit(bins)) - 1
    counted = values.where(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    return grid.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("count"))


def previous_differences(now: DataFrame, before: DataFrame) -> DataFrame:
    """agent_id, shifted_alt, departure_time_shift (signed; null if the alternative changed)."""
    old = before.select("agent_id", F.col("selected_alt_id").alias("old_alt"), F.col("departure_time").alias("old_departure"))
    joined = now.join(old, "agent_id")
    same = F.col("selected_alt_id") == F.col("old_alt")
    return joined.select("agent_id", (~same).alias("shifted_alt"), F.when(same, F.col("departure_time") - F.col("old_departure")).alias("departure_time_shift"))


def complexity(weights: DataFrame) -> DataFrame:
    """Functions, constants among them, and points of a table with a ``ttf``."""
    points = pwl.complexity(F.col("ttf"))
    return weights.agg(F.count("*").alias("functions"), F.count_if(pwl.is_constant(F.col("ttf"))).alias("constants"), F.sum(points).cast("bigint").alias("points"))


def travel_counts(legs: DataFrame) -> DataFrame:
    """Per agent: road and virtual trips, edges taken."""
    road = F.col("class_type") == "Road"
    return legs.groupBy("agent_id").agg(F.count_if(road).alias("nb_road_trips"), F.count_if(~road).alias("nb_virtual_trips"), F.sum(F.coalesce("nb_edges", F.lit(0))).alias("nb_edges"))
