"""Piecewise-linear functions of time as columns.

A function is a struct ``start_x, interval_x, points, cst``: values on an even grid, or, with null
``points``, the constant ``cst``.  Right of the grid the last value holds, left of it the first.
Everything is a column expression within one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPE = "struct<start_x: double, interval_x: double, points: array<double>, cst: double>"
MARGIN = 1e-8
ROUTING_MARGIN = 0.01


def piecewise(start_x: Column, interval_x: Column, points: Column) -> Column:
    return F.struct(start_x.cast("double").alias("start_x"), interval_x.cast("double").alias("interval_x"), points.cast("array<double>").alias("points"), F.lit(None).cast("double").alias("cst"))


def bind(f: Column, use) -> Column:
    """use(f) with f computed once: nested formulas would repeat its expression otherwise."""
    return F.get(F.transform(F.array(f), use), F.lit(0))


def constant(value: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("start_x"), F.lit(None).cast("double").alias("interval_x"), F.lit(None).cast("array<double>").alias("points"), value.cast("double").alias("cst"))


def from_values(start_x: Column, interval_x: Column, points: Column) -> Column:
    """Piecewise, or constant if all values are equal."""
    return F.when(F.array_min(points) == F.array_max(points), constant(F.element_at(points, 1))).otherwise(piecewise(start_x, interval_x, points))


def is_constant(f: Column) -> Column:
    return f["points"].isNull()


def evaluate(f: Column, x: Column) -> Column:
    """f(x)."""
    points, n = f["points"], F.size(f["points"])
    place = (x - f["start_x"]) / f["interval_x"]
    low = F.floor(place).cast("int")
    left, right = F.get(points, low), F.get(points, low + 1)
    inside = left + (place - low) * (right - left)
    return F.when(points.isNull(), f["cst"]).when(place >= n - 1, F.element_at(points, -1)).when(place <= 0, F.element_at(points, 1)).otherwise(inside)


def least(f: Column) -> Column:
    return F.coalesce(F.array_min(f["points"]), f["cst"])


def greatest(f: Column) -> Column:
    return F.coalesce(F.array_max(f["points"]), f["cst"])


def practically_constant(f: Column, bound: Column) -> Column:
    return greatest(f) - least(f) <= bound


def complexity(f: Column) -> Column:
    """Number of points, 0 of a constant."""
    return F.when(is_constant(f), 0).otherwise(F.size(f["points"]))


def x_at(f: Column, index: Column) -> Column:
    return f["start_x"] + index * f["interval_x"]


def middle_x(f: Column) -> Column:
    return x_at(f, F.floor(F.size(f["points"]) / 2))


def period_length(f: Column) -> Column:
    return f["interval_x"] * (F.size(f["points"]) - 1)


def pairs(f: Column) -> Column:
    """Consecutive points as struct<x0, y0, x1, y1>."""
    return F.transform(
        F.slice(f["points"], 2, F.greatest(F.size(f["points"]) - 1, F.lit(0))),
        lambda y, i: F.struct(x_at(f, i).alias("x0"), F.get(f["points"], i).alias("y0"), x_at(f, i + 1).alias("x1"), y.alias("y1")),
    )


def apply_values(f: Column, op) -> Column:
    """A monotone function of the values."""
    return F.when(is_constant(f), constant(op(f["cst"]))).otherwise(piecewise(f["start_x"], f["interval_x"], F.transform(f["points"], op)))


def add(f: Column, value: Column) -> Column:
    return apply_values(f, lambda y: y + value)


def link(f: Column, g: Column) -> Column:
    """h(x) = f(x) + g(x + f(x)): travel along f, then along g."""
    onward = piecewise(f["start_x"], f["interval_x"], F.transform(f["points"], lambda y, i: y + evaluate(g, x_at(f, i) + y)))
    from_constant = piecewise(g["start_x"], g["interval_x"], F.transform(g["points"], lambda y, i: f["cst"] + evaluate(g, x_at(g, i) + f["cst"])))
    return F.when(is_constant(f) & is_constant(g), constant(f["cst"] + g["cst"])).when(is_constant(f), from_constant).when(is_constant(g), add(f, g["cst"])).otherwise(onward)


def combine(f: Column, g: Column, op) -> Column:
    """Pointwise op(f, g)."""
    both = piecewise(f["start_x"], f["interval_x"], F.zip_with(f["points"], g["points"], op))
    return (
        F.when(is_constant(f) & is_constant(g), constant(op(f["cst"], g["cst"])))
        .when(is_constant(f), piecewise(g["start_x"], g["interval_x"], F.transform(g["points"], lambda y: op(f["cst"], y))))
        .when(is_constant(g), piecewise(f["start_x"], f["interval_x"], F.transform(f["points"], lambda y: op(y, g["cst"]))))
        .otherwise(both)
    )


def merge(f: Column, g: Column) -> Column:
    """Pointwise lesser; the whole other function where the ranges do not overlap."""
    return F.when(greatest(f) <= least(g), f).when(greatest(g) <= least(f), g).otherwise(combine(f, g, lambda a, b: F.least(a, b)))


def undercuts(f: Column, g: Column) -> Column:
    """Whether f is below g at a grid point."""
    below = combine(f, g, lambda a, b: F.when(a < b, 1.0).otherwise(0.0))
    return greatest(below) > 0


def squared_difference(f: Column, g: Column) -> Column:
    """Mean of (f - g)^2 over the period, exact: each segment gives (d0^2 + d0 d1 + d1^2) / 3."""
    d = combine(f, g, lambda a, b: a - b)
    segments = F.transform(pairs(d), lambda p: (p["y0"] * p["y0"] + p["y0"] * p["y1"] + p["y1"] * p["y1"]) / 3)
    mean = F.aggregate(segments, F.lit(0.0), lambda a, s: a + s) / (F.size(d["points"]) - 1)
    return F.when(is_constant(d), d["cst"] * d["cst"]).otherwise(mean)


def ensure_fifo(f: Column, margin: float = MARGIN) -> Column:
    """Raise values so that arrivals x + y grow by ``margin`` at least, each from the raised one before."""

    def raised(done: Column, y: Column) -> Column:
        return F.concat(done, F.array(F.when(F.size(done) == 0, y).otherwise(F.greatest(y, F.element_at(done, -1) - f["interval_x"] + margin))))

    points = F.aggregate(f["points"], F.array().cast("array<double>"), raised)
    return F.when(is_constant(f), f).otherwise(piecewise(f["start_x"], f["interval_x"], points))


def ensure_fifo_rows(rows: DataFrame, keys: list[str], x: str, y: str, margin: float = MARGIN) -> DataFrame:
    """The same over rows (keys, x, y) by a running maximum, for grids too long for one row."""
    order = Window.partitionBy(*keys).orderBy(x)
    place = F.row_number().over(order) - 1
    placed = rows.withColumn("fifo_k", place)
    peak = F.max(F.col(x) + F.col(y) - F.col("fifo_k") * margin).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(y, peak + F.col("fifo_k") * margin - F.col(x)).drop("fifo_k")


def relative_position(f: Column, g: Column) -> Column:
    """Where the order of f and g changes: array<struct<x, sign>>, sign of f - g from x on; the first is at the start."""
    d = combine(f, g, lambda a, b: a - b)

    def at(p: Column) -> Column:
        crossing = p["x0"] + d["interval_x"] * p["y0"] / (p["y0"] - p["y1"])
        return (
            F.when(p["y0"] * p["y1"] < 0, F.struct(crossing.alias("x"), F.signum(p["y1"]).alias("sign")))
            .when((p["y0"] == 0) & (p["y1"] != 0), F.struct(p["x0"].alias("x"), F.signum(p["y1"]).alias("sign")))
            .when((p["y1"] == 0) & (p["y0"] != 0), F.struct(p["x1"].alias("x"), F.lit(0.0).alias("sign")))
        )

    first = F.array(F.struct(d["start_x"].alias("x"), F.signum(F.element_at(d["points"], 1)).alias("sign")))
    changes = F.filter(F.transform(pairs(d), at), lambda c: c.isNotNull())
    listed = F.concat(first, changes)
    kept = F.filter(listed, lambda c, i: (i == 0) | (c["sign"] != F.get(listed, i - 1)["sign"]))
    return F.when(is_constant(d), F.array(F.struct(F.lit(0.0).alias("x"), F.signum(d["cst"]).alias("sign")))).otherwise(kept)


def build(rows: DataFrame, keys: list[str], x: str, y: str, start_x: float | None = None) -> DataFrame:
    """Long rows (keys, x, y) to one ``ttf`` for each key.

    One point, or equal values, make a constant.  Fails on an uneven grid, and on one that does not begin at ``start_x`` where that is given.
    """
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("xy"))
    step = F.get("xy", F.lit(1))["x"] - F.get("xy", F.lit(0))["x"]
    even = F.forall(F.expr("sequence(0, size(xy) - 1)"), lambda i: F.abs(F.get("xy", i)["x"] - (F.get("xy", F.lit(0))["x"] + i * F.coalesce(step, F.lit(0.0)))) <= 1e-6)
    problem = F.when(~even, F.lit("the x values are not evenly spaced"))
    if start_x is not None:
        problem = problem.when(F.abs(F.get("xy", F.lit(0))["x"] - start_x) > 1e-6, F.lit(f"the first x is not {start_x}"))
    points = F.transform("xy", lambda p: p["y"])
    made = F.when(F.size("xy") == 1, constant(F.get("xy", F.lit(0))["y"])).otherwise(from_values(F.get("xy", F.lit(0))["x"], step, points))
    return got.select(*keys, F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(made).cast(TYPE).alias("ttf"))


def sample(f: Column, start: float, end: float, interval: float) -> Column:
    """Values on start + k * interval up to the end: array<struct<departure_time, travel_time>>."""
    steps = int((end - start) / interval + 1e-9)
    xs = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.lit(float(start)) + k * F.lit(float(interval)))
    return F.transform(xs, lambda x: F.struct(x.alias("departure_time"), evaluate(f, x).alias("travel_time")))


def from_json_values(text: Column) -> Column:
    """A list of values from JSON, null standing for infinity."""
    return F.transform(F.from_json(text, "array<double>"), lambda y: F.coalesce(y, F.lit(float("inf"))))


def to_json_values(points: Column) -> Column:
    """The reverse of ``from_json_values``."""
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(points, lambda y: F.when(y == float("inf"), "null").otherwise(y.cast("string")))), F.lit("]"))
