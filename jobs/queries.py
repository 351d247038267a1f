"""The jobs as queries: each runs twice into one new folder and returns the output as it stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import link_loads, observed_conditions
from wayfare.plans import derived
from wayfare.sources.shared import shared_dir


def job1_observed_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        out = observed_conditions.run(spark, sf_dir, f"{folder}/out", f"{folder}/checkpoint")
    return out.select(F.col("day").cast("string").alias("day"), "edge_id", "departure_time", F.round("travel_time", 6).alias("travel_time"))


JOB1_SQL = f"""
WITH seen AS (SELECT * FROM {observed_conditions.OBSERVED} o WHERE edge_id IS NOT NULL AND t IS NOT NULL AND y IS NOT NULL),
placed AS (SELECT day, edge_id, floor(t / 3600e0)::BIGINT AS low, t / 3600e0 - floor(t / 3600e0) AS share, y FROM seen WHERE t BETWEEN 0 AND 86400),
halves AS (SELECT day, edge_id, low AS bin, 1e0 - share AS w, y FROM placed UNION ALL SELECT day, edge_id, low + 1, share, y FROM placed),
means AS (SELECT day, edge_id, bin, sum(w * y) / sum(w) AS y FROM halves WHERE w > 0 GROUP BY day, edge_id, bin),
grid AS (SELECT day, edge_id, unnest(generate_series(0, 24)) AS bin FROM (SELECT DISTINCT day, edge_id FROM seen) k),
timed AS (SELECT g.day, g.edge_id, g.bin, g.bin * 3600e0 AS x, length / speed + constant_travel_time + coalesce(y, 0e0) AS y FROM grid g
  LEFT JOIN means m ON m.day = g.day AND m.edge_id = g.edge_id AND m.bin = g.bin JOIN {derived.EDGES} e ON e.edge_id = g.edge_id)
SELECT day::VARCHAR AS day, edge_id, x AS departure_time, round(max(x + y - bin * 1e-8) OVER (PARTITION BY day, edge_id ORDER BY bin ROWS UNBOUNDED PRECEDING) + bin * 1e-8 - x, 6) AS travel_time FROM timed
"""


def job2_link_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        out = link_loads.run(spark, sf_dir, f"{folder}/out")
    return out.select("hour", "edge_id", "vehicles", *[F.abs(F.round(c, 4)).alias(c) for c in ("mean_wait", "longest_wait", "mean_time", "vehicle_hours")])


def _job2_sql() -> str:
    """Layer by layer, each road's gate in the order of the arrivals."""
    steps = [f"l0 AS (SELECT r.trip_id, r.edge_id, departure + r.trip_id % 8191 / 8191e0 AS reach FROM {derived.LAYER_ROUTES} r JOIN {derived.TRIPS} t ON t.trip_id = r.trip_id WHERE position = 0)"]
    for k in range(derived.LAYERS):
        steps.append(f"q{k} AS (SELECT l.*, length / speed AS spent, coalesce(1e0 / (flow * lanes), 0e0) AS closing FROM l{k} l JOIN {derived.LAYER_EDGES} e ON e.edge_id = l.edge_id)")
        steps.append(f"s{k} AS (SELECT *, sum(closing) OVER (PARTITION BY edge_id ORDER BY reach, trip_id ROWS UNBOUNDED PRECEDING) - closing AS served FROM q{k})")
        steps.append(f"e{k} AS (SELECT *, served + max(reach - served) OVER (PARTITION BY edge_id ORDER BY reach, trip_id ROWS UNBOUNDED PRECEDING) AS entry FROM s{k})")
        if k + 1 < derived.LAYERS:
            steps.append(f"l{k + 1} AS (SELECT e.trip_id, r.edge_id, entry + spent AS reach FROM e{k} e JOIN {derived.LAYER_ROUTES} r ON r.trip_id = e.trip_id AND r.position = {k + 1})")
    union = " UNION ALL ".join(f"SELECT edge_id, reach, entry, spent FROM e{k}" for k in range(derived.LAYERS))
    return f"""WITH {", ".join(steps)} SELECT floor(entry / 3600e0)::BIGINT AS hour, edge_id, count(*) AS vehicles, round(avg(entry - reach), 4) AS mean_wait, round(max(entry - reach), 4) AS longest_wait,
  round(avg(entry + spent - reach), 4) AS mean_time, round(sum(entry + spent - reach) / 3600e0, 4) AS vehicle_hours FROM ({union}) a GROUP BY 1, 2"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_observed_conditions, job2_link_loads)}
ORACLES: dict[str, str] = {"job1_observed_conditions": derived.sql(JOB1_SQL), "job2_link_loads": derived.sql(_job2_sql())}
