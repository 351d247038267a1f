"""Hand-computed values of functions, choices, learning and summaries."""

import math

import pytest
from pyspark.sql import functions as F

from wayfare.functions import pwl, scalars
from wayfare.operators import choice, learning, summary


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def f(points, start=0.0, interval=1.0):
    return pwl.piecewise(F.lit(start), F.lit(interval), F.lit([float(p) for p in points]))


def c(y):
    return pwl.constant(F.lit(float(y)))


def test_evaluate(spark):
    g = f([10, 20, 15], 100.0, 10.0)
    got = [value(spark, pwl.evaluate(g, F.lit(x))) for x in (90.0, 100.0, 105.0, 110.0, 120.0, 1000.0)]
    assert got == [10, 10, 15, 20, 15, 15]
    assert value(spark, pwl.evaluate(c(3), F.lit(7.0))) == 3


def test_squared_difference(spark):
    assert value(spark, pwl.squared_difference(f([0, 1, 2]), f([1, 0, 0]))) == pytest.approx((1 / 6 + 1 / 6 + 7 / 3) / 2)
    assert value(spark, pwl.squared_difference(c(1), c(3))) == 4


def test_crossing(spark):
    got = value(spark, pwl.relative_position(c(13), f([10, 15, 40, 40], 0.0, 30.0)))
    assert [(r.x, r.sign) for r in got] == [(0, 1), (18, -1)]


def test_link_merge_fifo(spark):
    assert value(spark, pwl.link(f([1, 2, 3], 0, 10), f([5, 15, 5], 0, 10))).points == pytest.approx([1 + 6, 2 + 13, 3 + 5])
    assert value(spark, pwl.link(c(5), f([0, 10, 0], 0, 10))).points == [10, 10, 5]
    assert value(spark, pwl.link(c(5), c(2))).cst == 7
    assert value(spark, pwl.merge(f([1, 5]), c(3))).points == [1, 3]
    assert value(spark, pwl.merge(f([4, 5]), c(3))).cst == 3
    assert value(spark, pwl.undercuts(f([1, 5]), c(3))) and not value(spark, pwl.undercuts(f([4, 5]), c(3)))
    assert value(spark, pwl.ensure_fifo(f([5, 1, 1], 0, 1), 0.5)).points == pytest.approx([5, 4.5, 4.0])
    assert value(spark, pwl.complexity(f([1, 2, 3]))) == 3 and value(spark, pwl.middle_x(f([1, 2, 3], 0, 10))) == 10 and value(spark, pwl.period_length(f([1, 2, 3], 0, 10))) == 20


def test_build(spark):
    rows = spark.createDataFrame([("a", 20.0, 3.0), ("a", 0.0, 1.0), ("a", 10.0, 2.0), ("b", 0.0, 4.0), ("b", 10.0, 4.0), ("c", 0.0, 9.0)], "k string, x double, y double")
    got = {r.k: r.ttf for r in pwl.build(rows, ["k"], "x", "y").collect()}
    assert got["a"].points == [1, 2, 3] and got["a"].interval_x == 10 and got["b"].cst == 4 and got["c"].cst == 9
    with pytest.raises(Exception, match="evenly"):
        pwl.build(spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 3.0, 1.0)], "k int, x double, y double"), ["k"], "x", "y").collect()


def test_speeds(spark):
    none, x, y = F.lit(None), F.lit([10.0, 20.0]), F.lit([8.0, 18.0])
    speed = lambda base, kind: value(spark, scalars.vehicle_speed(F.lit(base), F.lit(kind), F.lit(15.0), F.lit(0.5), x, y))
    assert [speed(12.0, "UpperBound"), speed(18.0, "UpperBound"), speed(12.0, "Multiplicator"), speed(12.0, "Base")] == [12, 15, 6, 12]
    assert [speed(v, "Piecewise") for v in (5.0, 10.0, 15.0, 20.0, 25.0)] == [5, 8, 13, 18, 25]
    regimes = lambda occ: value(spark, scalars.congested_speed(F.lit(10.0), F.lit(occ), F.lit(100.0), F.lit("ThreeRegimes"), none, F.lit(0.2), F.lit(0.8), F.lit(2.0), F.lit(1.0)))
    assert [regimes(v) for v in (10.0, 50.0, 90.0)] == pytest.approx([10, 6, 2])
    assert value(spark, scalars.flow_at(F.lit(5.0), F.lit([10.0, 20.0]), F.lit([1.0, 2.0]))) == 1


def test_utilities(spark):
    one = [F.lit(v) for v in (1.0, 2.0, 3.0, 4.0, 5.0)]
    assert value(spark, scalars.travel_utility(F.lit(2.0), *one, alpha=F.lit(1.0))) == 1 + 2 * 1 + 4 * 3 + 8 * 4 + 16 * 5
    late = lambda t: value(spark, scalars.schedule_utility(F.lit(t), F.lit("Linear"), F.lit(10.0), F.lit(1.0), F.lit(2.0), F.lit(4.0)))
    assert [late(t) for t in (5.0, 8.0, 12.0, 13.0)] == [-3, 0, 0, -2]
    assert value(spark, scalars.clock(F.lit(3661.0))) == "01:01:01"


def test_choices(spark):
    rows = spark.createDataFrame([(1, i, v, 1.0, 1.0) for i, v in enumerate([1.0, 3.0, 3.0])], "a int, i int, v double, u double, mu double")
    got = choice.deterministic(rows, "a", "i", "v", "u").first()
    assert (got.chosen, got.payoff) == (2, 3)
    got = choice.logit(rows, "a", "i", "v", "u", "mu").first()
    assert got.chosen == 2 and got.payoff == pytest.approx(math.log(math.e + 2 * math.e**3) + choice.EULER)
    low = choice.logit(rows.withColumn("u", F.lit(0.0)), "a", "i", "v", "u", "mu").first()
    assert low.chosen == 0
    flat = value(spark, choice.continuous_logit(f([1, 1, 1], 0, 10), F.lit(0.25), F.lit(2.0)))
    assert flat.x == pytest.approx(5) and flat.payoff == pytest.approx(1 + 2 * (math.log(20) + choice.EULER))
    mask = choice.update_mask(spark.range(1000).select(F.col("id").alias("agent_id")), "agent_id", 0.25, 3, 1)
    assert mask.where("updates").count() == 250 and mask.count() == 1000


def test_learning_sequences(spark):
    def run(model, value_=None):
        x, out = 20.0, []
        for t, y in enumerate([10.0, 6.0, 8.0]):
            x = value(spark, learning.learn(c(x), c(y), model, F.lit(t + 1), value_)).cst
            out.append(x)
        return out

    assert run("Linear") == pytest.approx([15, 12, 11])
    assert run("ExponentialUnadjusted", 0.5) == pytest.approx([15, 10.5, 9.25])
    assert run("Exponential", 0) == run("Linear")
    assert run("Genetic")[0] == pytest.approx(math.sqrt(200))


def test_summaries(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)] + [(None,)], "x double")
    got = rows.agg(*summary.distribution(F.col("x"), "d")).first()
    assert (got.d_mean, got.d_std, got.d_min, got.d_max) == (3, pytest.approx(math.sqrt(2)), 1, 5)
    rows = spark.createDataFrame([(v,) for v in (3.0, 5.0, 5.1, 5.2, 9.0, 12.0, 15.0)], "x double")
    counts = [r["count"] for r in summary.histogram(rows, "x", 0.0, 256.0).orderBy("bin").collect()]
    assert counts[:10] == [0, 1, 3, 0, 1, 1, 0, 1, 0, 0] and len(counts) == 128


def test_json_values(spark):
    got = value(spark, pwl.from_json_values(F.lit("[1, null, 2.5]")))
    assert got == [1, math.inf, 2.5] and value(spark, pwl.to_json_values(F.lit(got))) == "[1.0,null,2.5]"


def test_utility_of_a_trip_with_four_legs(spark):
    zero, none = F.lit(0.0), F.lit(None).cast("double")

    def leg(ttf, stop, poly, schedule):
        constant, one, two = poly
        kind, tstar, delta, beta, gamma = schedule or (None, None, None, None, None)
        return F.struct(
            ttf.cast(pwl.TYPE).alias("ttf"), F.lit(float(stop)).alias("stopping"), F.lit(float(constant)).alias("constant"), F.lit(float(one)).alias("one"), F.lit(float(two)).alias("two"), zero.alias("three"), zero.alias("four"), zero.alias("alpha"),
            F.lit(kind).cast("string").alias("kind"), *[F.lit(v).cast("double").alias(k) for k, v in (("tstar", tstar), ("beta", beta), ("gamma", gamma), ("delta", delta))],
        )

    legs = F.array(
        leg(c(1), 2, (1, -1, 1), ("Linear", 5.5, 1.0, 0.5, 2.0)),
        leg(f([0, 10, 5], 0, 10), 1, (0, -1, 0), ("Linear", 10.0, 0.0, 0.1, 0.2)),
        leg(c(4), 1, (5, 0, 0), None),
        leg(c(0), 0, (0, 0, 0), None),
    )
    side = lambda t: {"kind": F.lit("Linear"), "tstar": F.lit(t), "beta": F.lit(2.0), "gamma": F.lit(2.0), "delta": none}
    total = {"constant": zero, "one": zero, "two": F.lit(-2.0), "three": zero, "four": zero}
    assert value(spark, scalars.trip_utility(F.lit(0.0), F.lit(3.0), legs, total, side(1.0), side(15.0))) == pytest.approx(-250.9)
