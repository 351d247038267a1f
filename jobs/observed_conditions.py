"""Incremental job: observed waits on roads to network conditions, the travel times by time of day that a simulation starts from.

    python jobs/observed_conditions.py --tables FOLDER --output FOLDER --checkpoint FOLDER [--config FILE] [--interval SECONDS] [--end SECONDS]

A file stream takes the files of the table ``events`` that no earlier run took (its checkpoint is the mark).  Each micro-batch is written
to ``observations``, partitioned by day and batch, then ``conditions`` of the days that it touches, late ones included, are computed anew
from all their observations and replace those partitions.  A batch that runs again overwrites what it wrote, so that a run
that is stopped anywhere and started again has the same result; a run without new files changes nothing.  The checkpoint belongs to its output.

Defined results: rows without a time, road or value are no observations; an event_id that comes again, in the same or a later file, counts
once, as it came first; rows without an event_id all count; without events the tables are empty.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import pwl, scalars
from wayfare.plans import derived
from wayfare.streaming import gates

log = logging.getLogger("jobs.observed_conditions")

OBSERVATIONS = "event_id long, edge_id long, t double, y double, day date, batch long"
CONDITIONS = "edge_id long, departure_time double, travel_time double, day date"
#: Day, road, second of the day and wait of each event.
OBSERVED = f"""(SELECT event_id, user_id % (2 * {derived.NODES}) AS edge_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS DOUBLE) AS t, value * 1.000037e0 AS y,
  CAST(ts AS DATE) AS day FROM {{events}})"""


def conditions(observations: DataFrame, edges: DataFrame, interval: float, end: float) -> DataFrame:
    """Travel time of each day and road with observations on the grid of departure times: free flow and mean wait, raised where a later departure would arrive earlier."""
    known = observations.where("event_id is not null").groupBy("day", "event_id").agg(F.min(F.struct("batch", "edge_id", "t", "y")).alias("first")).select("day", "first.edge_id", "first.t", "first.y")
    once = known.unionByName(observations.where("event_id is null").select("day", "edge_id", "t", "y"))
    means = gates.observe(once, ["day", "edge_id"], "t", "y", 0.0, end, interval)
    free = edges.select("edge_id", scalars.edge_travel_time(F.col("length"), F.col("speed"), F.col("constant_travel_time")).alias("free"))
    timed = means.join(free, "edge_id").select("day", "edge_id", F.col("x").alias("departure_time"), (F.col("free") + F.col("y")).alias("travel_time"))
    return pwl.ensure_fifo_rows(timed, ["day", "edge_id"], "departure_time", "travel_time").select("edge_id", "departure_time", "travel_time", "day")


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, interval: float = 3600.0, end: float = 86400.0) -> DataFrame:
    """Takes what is new in ``tables``/events.parquet and returns the whole table of conditions, read back."""
    events, stored, made = f"{tables.rstrip('/')}/events.parquet", f"{output.rstrip('/')}/observations", f"{output.rstrip('/')}/conditions"
    edges = derived.frame(spark, tables, derived.EDGES)
    for path, ddl, parts in ((stored, OBSERVATIONS, ["day", "batch"]), (made, CONDITIONS, ["day"])):  # readable before the first batch
        spark.createDataFrame([], ddl).write.mode("append").partitionBy(*parts).parquet(path)

    def take(batch: DataFrame, batch_id: int) -> None:
        suppliers = batch.sparkSession.read.parquet(f"{tables.rstrip('/')}/supplier.parquet")
        seen = batch.sparkSession.sql(f"SELECT * FROM {OBSERVED} o WHERE edge_id IS NOT NULL AND t IS NOT NULL AND y IS NOT NULL", events=batch, supplier=suppliers)
        numbered = seen.withColumn("batch", F.lit(batch_id).cast("long"))
        numbered.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(stored)
        everything = spark.read.schema(OBSERVATIONS).parquet(stored)
        days = everything.where(F.col("batch") == batch_id).select("day").distinct()
        touched = everything.join(days, "day", "left_semi")
        new = conditions(touched, edges, float(interval), float(end))
        new.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(made)
        log.info("batch %s: %s rows read, conditions of %s days written to %s", batch_id, everything.where(F.col("batch") == batch_id).count(), days.count(), made)

    # the last letter in brackets makes the path a pattern, which may name a file as well as a folder
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(f"{events[:-1]}[{events[-1]}]")
    running = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    log.info("%s: %s batches of new files", events, sum(1 for p in running.recentProgress if p["numInputRows"]))
    return spark.read.schema(CONDITIONS).parquet(made)


if __name__ == "__main__":
    from jobs import command
    from jobs.observed_conditions import run as job

    sys.exit(command.main(job, os.path.join(os.path.dirname(os.path.abspath(__file__)), "observed_conditions.json"), ("tables", "output", "checkpoint")))
