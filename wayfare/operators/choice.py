"""Choices between ordered alternatives, with the uniform draw ``u`` as data.

Tables are rows (key, index, value); a key's rows are a few alternatives, so that a window by key
is one shuffle of small groups.  Continuous choices fold within one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import pwl

EULER = 0.5772156649015329


def deterministic(rows: DataFrame, key: str, index: str, value: str, u: str, constants: str | None = None) -> DataFrame:
    """key, chosen index, payoff: the greatest value (constants are cycled); of ties the floor(u * ties)-th."""
    w = Window.partitionBy(key)
    order = w.orderBy(index)
    total = F.col(value)
    if constants:
        n = F.size(constants)
        total = total + F.when(n > 0, F.get(constants, F.pmod(F.row_number().over(order) - 1, F.greatest(n, F.lit(1))))).otherwise(0.0)
    best = rows.withColumn("choice_value", total).withColumn("choice_best", F.max("choice_value").over(w)).where("choice_value = choice_best")
    ties = best.withColumn("choice_rank", F.row_number().over(order) - 1).withColumn("choice_ties", F.count("*").over(w))
    pick = F.least(F.floor(F.col(u) * F.col("choice_ties")), F.col("choice_ties") - 1)
    return ties.where(F.col("choice_rank") == pick).select(key, F.col(index).alias("chosen"), F.col("choice_best").alias("payoff"))


def logit(rows: DataFrame, key: str, index: str, value: str, u: str, mu: str) -> DataFrame:
    """key, chosen index, payoff: first alternative whose cumulative probability exceeds u (else the last); log-sum plus Euler's constant."""
    w = Window.partitionBy(key)
    order = w.orderBy(index)
    scaled = rows.withColumn("choice_best", F.max(value).over(w)).withColumn("choice_e", F.exp((F.col(value) - F.col("choice_best")) / F.col(mu)))
    cumulative = scaled.withColumn("choice_sum", F.sum("choice_e").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("choice_all", F.max("choice_sum").over(w)).withColumn("choice_last", F.max(index).over(w))
    above = (F.col("choice_sum") / F.col("choice_all") > F.col(u)) | (F.col(index) == F.col("choice_last"))
    payoff = F.first("choice_best") + F.first(mu) * (F.log(F.first("choice_all")) + EULER)
    return cumulative.groupBy(key).agg(F.min(F.when(above, F.col(index))).alias("chosen"), payoff.alias("payoff"))


def choose(rows: DataFrame, key: str, index: str, value: str, kind: str, u: str, mu: str, constants: str) -> DataFrame:
    """Dispatch on the column ``kind``: Logit, Deterministic, or First (also null)."""
    cond = F.coalesce(F.col(kind), F.lit("First"))
    first = rows.where(cond == "First").groupBy(key).agg(F.min(index).alias("chosen"), F.min_by(value, index).alias("payoff"))
    fixed = deterministic(rows.where(cond == "Deterministic").withColumn(u, F.coalesce(u, F.lit(0.0))), key, index, value, u, constants)
    return first.unionByName(fixed).unionByName(logit(rows.where(cond == "Logit"), key, index, value, u, mu))


def continuous_logit(f: Column, u: Column, mu: Column) -> Column:
    """struct<x, payoff> of a choice over a utility function of time, by inverse transform.

    exp(y / mu) is integrated over each segment exactly.  If all of it underflows, the grid points
    are chosen between as a discrete logit would.  Null without a function of points, ``u`` or ``mu``.
    What the folds over segments and points read is bound, so that no step of a fold computes it anew.
    """

    def mass(p: Column) -> Column:
        dx = p["x1"] - p["x0"]
        flat = F.exp(p["y0"] / mu) * dx
        return F.when(p["y0"] == p["y1"], flat).otherwise(mu * dx / (p["y1"] - p["y0"]) * (F.exp(p["y1"] / mu) - F.exp(p["y0"] / mu)))

    def inverse(p: Column, rest: Column) -> Column:
        theta = (p["y1"] - p["y0"]) / (p["x1"] - p["x0"])
        flat = p["x0"] + rest / F.exp(p["y0"] / mu)
        x = p["x0"] + (mu / theta) * F.log(theta * rest / mu + F.exp(p["y0"] / mu)) - p["y0"] / theta
        return F.least(F.greatest(F.when(p["y0"] == p["y1"], flat).otherwise(x), p["x0"]), p["x1"])

    def listed(f: Column, top: Column) -> Column:
        shifted = F.transform(pwl.pairs(f), lambda p: F.struct(p["x0"].alias("x0"), p["x1"].alias("x1"), (p["y0"] - top).alias("y0"), (p["y1"] - top).alias("y1")))
        segments = F.transform(shifted, lambda p: p.withField("g", mass(p)))
        # the discrete logit: the first point whose cumulative weight is above u of all, else the last
        weights = F.transform(f["points"], lambda y: F.exp((y - top) / mu))
        return F.struct(segments.alias("segments"), weights.alias("weights"))

    def summed(s: Column) -> Column:
        total = F.aggregate(s["segments"], F.lit(0.0), lambda a, p: a + p["g"])
        whole = F.aggregate(s["weights"], F.lit(0.0), lambda a, w: a + w)
        return F.struct(total.alias("total"), whole.alias("whole"))

    def drawn(f: Column, top: Column, s: Column, sums: Column) -> Column:
        segments, weights, total, whole = s["segments"], s["weights"], sums["total"], sums["whole"]

        def step(state: Column, p: Column) -> Column:
            here = state["x"].isNull() & (state["sum"] + p["g"] > u * total)
            return F.struct((state["sum"] + p["g"]).alias("sum"), F.when(here, inverse(p, u * total - state["sum"])).otherwise(state["x"]).alias("x"))

        found = F.aggregate(segments, F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("x")), step)["x"]
        last = F.element_at(segments, -1)["x1"]

        def pick(state: Column, w: Column) -> Column:
            here = state["k"].isNull() & (state["sum"] + w > u * whole)
            return F.struct((state["sum"] + w).alias("sum"), F.when(here, state["i"]).otherwise(state["k"]).alias("k"), (state["i"] + 1).alias("i"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("k"), F.lit(0).alias("i"))
        point = pwl.x_at(f, F.coalesce(F.aggregate(weights, start, pick)["k"], F.size(f["points"]) - 1))
        x = F.when(total == 0, point).otherwise(F.coalesce(found, last))
        payoff = top + mu * (F.log(F.when(total > 0, total).otherwise(whole)) + EULER)
        return F.when(f["points"].isNotNull() & u.isNotNull() & mu.isNotNull(), F.struct(x.alias("x"), payoff.alias("payoff")))

    return pwl.bind(f, lambda f: pwl.bind(F.array_max(f["points"]), lambda top: pwl.bind(listed(f, top), lambda s: pwl.bind(summed(s), lambda sums: drawn(f, top, s, sums)))))


def departure_grid(start: float, end: float, interval: Column) -> Column:
    """Midpoints start + interval / 2 + k * interval strictly below the end."""
    n = F.ceil((F.lit(end) - F.lit(start) - interval / 2) / interval).cast("int")
    checked = F.when(interval > 0, n).otherwise(F.raise_error(F.lit("the interval must be positive")).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(checked, F.lit(1)) - 1), lambda k: F.lit(float(start)) + interval / 2 + k * interval)


def shifted_departure(midpoint: Column, offset: Column, start: float, end: float) -> Column:
    """The offset is added after the choice; the result stays within the period."""
    return F.least(F.greatest(midpoint + F.coalesce(offset, F.lit(0.0)), F.lit(float(start))), F.lit(float(end)))


def update_mask(agents: DataFrame, key: str, ratio: float, seed: int, iteration: int) -> DataFrame:
    """key, updates: exactly floor(ratio * agents) of them, in the order of a seeded hash (the first 60 bits of an MD5, so that other engines find the same ones).

    The threshold is found by ranks in hash buckets, so that no window holds all agents.
    """
    digest = F.md5(F.concat(F.lit(f"{seed + iteration}:"), F.col(key).cast("string")))
    hashed = agents.select(key, F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("mask_h")).withColumn("mask_b", F.shiftright("mask_h", 48))
    by_bucket = hashed.groupBy("mask_b").agg(F.count("*").alias("mask_n"))
    before = by_bucket.withColumn("mask_before", F.coalesce(F.sum("mask_n").over(Window.orderBy("mask_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.floor(F.lit(ratio) * F.sum("mask_n").over(Window.partitionBy()))
    before = before.withColumn("mask_wanted", wanted).drop("mask_n")
    rank = F.row_number().over(Window.partitionBy("mask_b").orderBy("mask_h", key))
    return hashed.join(before, "mask_b").select(key, (F.col("mask_before") + rank <= F.col("mask_wanted")).alias("updates"))
