"""Observations of waiting times as a stream: the grid of ``gates.observe``, kept up to date as records come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observe_stream(records: DataFrame, keys: list[str], event_time: str, value: str, interval: str, delay: str) -> DataFrame:
    """keys, point, y: weighted means at grid points over a table with a timestamp column, streaming or not.

    Each record counts for the two grid points beside it by nearness.  The records that count for a point are those of the window of two
    intervals around it, so that sliding windows hold each point's sums in one state: a point is emitted once, as soon as the
    watermark, ``delay`` behind the newest record, has passed the next point.  ``interval`` is of a fixed length (no months).

    Records without a time are left out, those without a value count for no mean; a record that comes when the watermark has passed both its
    points is dropped, one that comes between them counts for the later point alone.  Points without records are not emitted.
    """
    step = F.expr(f"interval {interval}")
    around = F.window(event_time, f"{2 * _micros(records, interval)} microseconds", interval)
    marked = records.withWatermark(event_time, delay).where(F.col(event_time).isNotNull()).withColumn("window", around)
    point = F.col("window.start") + step
    far = F.abs(F.unix_micros(event_time) - F.unix_micros(point)) / F.lit(float(_micros(records, interval)))
    weight = F.when(F.col(value).isNotNull(), 1 - far)
    sums = marked.groupBy(*keys, "window").agg(F.sum(F.col(value) * weight).alias("total"), F.sum(weight).alias("weight"))
    return sums.where("weight > 0").select(*keys, (F.col("window.start") + step).alias("point"), (F.col("total") / F.col("weight")).alias("y"))


def _micros(records: DataFrame, interval: str) -> int:
    """Length of a fixed interval."""
    return records.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {interval}) AS n").first().n
