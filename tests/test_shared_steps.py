"""What a fold reads is made once a row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl, scalars
from wayfare.operators import choice


def _plan(table) -> str:
    return table._jdf.queryExecution().analyzed().toString()


def _drawn(start, step, ys, u, mu):
    """The draw and payoff by one pass over the segments."""
    top = max(ys)
    pieces = []
    for k, (a, b) in enumerate(zip(ys, ys[1:])):
        a, b = a - top, b - top
        pieces.append((start + k * step, a, b, math.exp(a / mu) * step if a == b else mu * step / (b - a) * (math.exp(b / mu) - math.exp(a / mu))))
    total, done = sum(p[3] for p in pieces), 0.0
    for x, a, b, g in pieces:
        if done + g > u * total:
            slope, rest = (b - a) / step, u * total - done
            found = x + rest / math.exp(a / mu) if a == b else x + mu / slope * math.log(slope * rest / mu + math.exp(a / mu)) - a / slope
            return min(max(found, x), x + step), top + mu * (math.log(total) + choice.EULER)
        done += g
    return start + step * len(pieces), top + mu * (math.log(total) + choice.EULER)


def test_continuous_logit_sums_once(spark):
    rng = random.Random(3)
    rows = [(k, 100.0 * k, [float(rng.randint(-8, 8)) for _ in range(2 + k % 30)], rng.random(), 1.0 + k % 3) for k in range(60)]
    table = spark.createDataFrame(rows, "k long, lo double, ys array<double>, u double, mu double")
    got = table.select("k", choice.continuous_logit(pwl.piecewise(F.col("lo"), F.lit(60.0), F.col("ys")), F.col("u"), F.col("mu")).alias("c"))
    for r in got.collect():
        _, lo, ys, u, mu = rows[r.k]
        assert tuple(r.c) == pytest.approx(_drawn(lo, 60.0, ys, u, mu))
    assert _plan(got).count("array_max(") == 1 and _plan(got).count("aggregate(") == 4  # two sums and two searches


def test_trip_utility_folds_once(spark):
    leg = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in (("stopping", 3.0), ("constant", 1.0), ("one", -1.0), ("two", 0.5), ("three", 0.0), ("four", 0.0), ("alpha", 0.0), ("tstar", 9.0), ("beta", 1.0), ("gamma", 2.0), ("delta", 0.0))], F.lit("Linear").alias("kind"), pwl.constant(F.lit(4.0)).alias("ttf"))
    none = {k: F.lit(None).cast("string" if k == "kind" else "double") for k in ("kind", "tstar", "beta", "gamma", "delta")}
    late = {"kind": F.lit("Linear"), "tstar": F.lit(20.0), "beta": F.lit(1.0), "gamma": F.lit(1.0), "delta": F.lit(0.0)}
    total = {k: F.lit(0.0) for k in ("constant", "two", "three", "four", "alpha")} | {"one": F.lit(-0.1)}
    got = spark.range(1).select(scalars.trip_utility(F.lit(2.0), F.lit(1.0), F.array(leg, leg), total, none, late).alias("v"))
    # two legs of 4 s each (1 - 4 + 8 = 5): arrivals 7 and 14, the end at 17
    assert got.first().v == pytest.approx(2 * 5 - 2 - 10 - 0.8 - 3)
    assert _plan(got).count("aggregate(") == 1
