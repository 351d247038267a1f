"""Day-to-day learning: averages of old and simulated functions, and their distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import pwl


def update_weight(model: str, iteration: Column, value: float | None = None) -> Column:
    """Weight of the new value; ``iteration`` counts from 1 (the caller passes its counter plus one, as the run loop does)."""
    t = iteration.cast("double")
    if model == "Exponential" and value == 0:
        model = "Linear"
    if model == "Linear":
        return 1 / (t + 1)
    if model == "Quadratic":
        return 1 / (F.sqrt(t) + 1)
    if model == "Exponential":
        return value / (1 - F.pow(F.lit(1.0 - value), t + 1))
    if model == "ExponentialUnadjusted":
        return F.lit(float(value))
    raise ValueError(f"unknown learning model {model}")


def learn(old: Column, new: Column, model: str, iteration: Column, value: float | None = None) -> Column:
    """The next expected function; ``Genetic`` is a weighted geometric mean."""
    if model == "Genetic":
        t = iteration.cast("double")
        return pwl.combine(old, new, lambda x, y: F.pow(x, t / (t + 1)) * F.pow(y, 1 / (t + 1)))
    w = update_weight(model, iteration, value)
    return pwl.combine(old, new, lambda x, y: x * (1 - w) + y * w)


def learn_weights(old: DataFrame, new: DataFrame, model: str, iteration: int, value: float | None = None) -> DataFrame:
    """(uvehicle, edge_id, ttf) of both tables; fails where one lacks a key of the other."""
    joined = old.withColumnRenamed("ttf", "old_ttf").join(new.withColumnRenamed("ttf", "new_ttf"), ["uvehicle", "edge_id"], "full_outer")
    known = F.when(F.col("old_ttf").isNull() | F.col("new_ttf").isNull(), F.raise_error(F.lit("the two weights have different edges")))
    ttf = F.coalesce(known.cast(pwl.TYPE), learn(F.col("old_ttf"), F.col("new_ttf"), model, F.lit(iteration), value))
    return joined.select("uvehicle", "edge_id", ttf.alias("ttf"))


def weights_rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root of the mean over vehicles and edges of the mean squared difference over the period."""
    joined = a.withColumnRenamed("ttf", "a_ttf").join(b.withColumnRenamed("ttf", "b_ttf"), ["uvehicle", "edge_id"])
    return joined.agg(F.sqrt(F.avg(pwl.squared_difference(F.col("a_ttf"), F.col("b_ttf")))).alias("rmse"))


def stop(counter: int, first: int, most: int) -> bool:
    return 1 + counter - first >= most
