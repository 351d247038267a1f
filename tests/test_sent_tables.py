"""What joins send by the driver: tables that were measured to be small, however small the files of others are."""

import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.plans import catalogue_day, simulation
from wayfare.sources import files, shared


@pytest.fixture(params=["constants", "points"])
def alike(spark, request):
    """400,000 rows, or a tenth of them with arrays, in files of less than a megabyte."""
    points = F.array_repeat(F.lit(0.0), 25) if request.param == "points" else F.lit(None).cast("array<double>")
    ttf = F.struct(F.lit(0.0).alias("start_x"), F.lit(3600.0).alias("interval_x"), points.alias("points"), F.lit(1.0).alias("cst")).cast(pwl.TYPE)
    return spark.range(0, 40_000 if request.param == "points" else 400_000, 1, 2).select((F.col("id") % 1000).alias("edge_id"), ttf.alias("ttf"))


def test_a_table_of_small_files_and_many_rows_is_not_sent(spark, alike):
    table = simulation.cut(alike, "weights")
    assert files.size(table.inputFiles()[0].rpartition("/")[0], spark) < 1 << 20
    plan = spark.range(1000).join(table, F.col("id") == F.col("edge_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert table.count() == alike.count() and table.dtypes == alike.dtypes


def test_a_small_table_is_sent(spark):
    table = catalogue_day.cut(spark.range(100).withColumn("name", F.lit("x")), "small")
    assert "BroadcastHashJoin" in spark.range(1_000_000).join(table, "id")._jdf.queryExecution().executedPlan().toString()
    assert shared.cut_sized(spark.range(10).where("id > 99")).count() == 0
