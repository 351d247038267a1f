"""Scalar formulas of the engine as column expressions.  Times are seconds after midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def travel_utility(t: Column, constant: Column, one: Column, two: Column, three: Column, four: Column, alpha: Column | None = None) -> Column:
    """constant + (one - alpha) t + two t^2 + three t^3 + four t^4, nulls as 0, by Horner's rule."""
    slope = _zero(one) - (_zero(alpha) if alpha is not None else F.lit(0.0))
    return _zero(constant) + t * (slope + t * (_zero(two) + t * (_zero(three) + t * _zero(four))))


def schedule_utility(t: Column, kind: Column, tstar: Column, beta: Column, gamma: Column, delta: Column) -> Column:
    """-beta (tstar - delta/2 - t)+ - gamma (t - tstar - delta/2)+; 0 without a kind (``Linear``, or its old name ``AlphaBetaGamma``)."""
    low, high = tstar - _zero(delta) / 2, tstar + _zero(delta) / 2
    value = F.when(t < low, -_zero(beta) * (low - t)).when(t > high, -_zero(gamma) * (t - high)).otherwise(0.0)
    return F.when(kind.isNull(), 0.0).when(kind.isin("Linear", "AlphaBetaGamma"), value).otherwise(F.raise_error(F.concat(F.lit("unknown schedule utility "), kind)))


def schedule_kinks(tstar: Column, delta: Column) -> Column:
    return F.array_distinct(F.array(tstar - _zero(delta) / 2, tstar + _zero(delta) / 2))


def vehicle_speed(base: Column, kind: Column, upper_bound: Column, coef: Column, x: Column, y: Column) -> Column:
    """Speed of a vehicle type on an edge of speed ``base``; out of the range of x, a piecewise function is the identity."""
    last = F.size(F.filter(x, lambda v: v <= base)) - 1
    x0, x1, y0, y1 = F.get(x, last), F.get(x, last + 1), F.get(y, last), F.get(y, last + 1)
    inside = F.when(x0 == base, y0).when((last >= 0) & x1.isNotNull(), y0 + (y1 - y0) * (base - x0) / (x1 - x0)).otherwise(base)
    return F.when(kind == "UpperBound", F.least(base, upper_bound)).when(kind == "Multiplicator", base * coef).when(kind == "Piecewise", inside).otherwise(base)


def congested_speed(base: Column, occupied: Column, total_length: Column, kind: Column, capacity: Column, min_density: Column, jam_density: Column, jam_speed: Column, beta: Column) -> Column:
    """Speed at an occupied length by free flow, bottleneck or three regimes."""
    queued = F.when((occupied <= capacity * (total_length / base)) | (total_length == 0), base).otherwise(total_length / occupied * capacity)
    density = F.when(total_length == 0, 0.0).otherwise(occupied / total_length)
    share = F.pow((density - min_density) / (jam_density - min_density), beta)
    regimes = F.when(density >= jam_density, F.least(jam_speed, base)).when(density > min_density, F.least(base * (1 - share) + jam_speed * share, base)).otherwise(base)
    return F.when(kind == "Bottleneck", queued).when(kind == "ThreeRegimes", regimes).otherwise(base)


def edge_travel_time(length: Column, speed: Column, constant_travel_time: Column) -> Column:
    return length / speed + _zero(constant_travel_time)


def flow_at(t: Column, times: Column, flows: Column) -> Column:
    """The flow of the last time at or before t; before the first time, the first flow."""
    n = F.size(F.filter(times, lambda v: v <= t))
    return F.get(flows, F.greatest(n - 1, F.lit(0)))


def closing_time(pce: Column, flow: Column, lanes: Column) -> Column:
    """Seconds for which a gate closes behind a vehicle; 0 without a limit of flow."""
    return F.when(flow.isNull(), 0.0).otherwise(pce / (flow * lanes))


def congestion(travel_time: Column, free_flow: Column) -> Column:
    return F.when(free_flow == 0, 0.0).otherwise((travel_time - free_flow) / free_flow)


def relative_difference(actual: Column, expected: Column) -> Column:
    return F.when(expected == 0, 0.0).otherwise((actual - expected) / expected)


def total_stopping_time(origin_delay: Column, stops: Column) -> Column:
    """Origin delay and all stops of a trip's legs."""
    return F.aggregate(stops, _zero(origin_delay), lambda a, x: a + _zero(x))


def contains(start: Column, end: Column, x: Column) -> Column:
    return x.between(start, end)


def clock(seconds: Column) -> Column:
    """hh:mm:ss of seconds after midnight."""
    whole = F.round(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)))


def can_access(edge: Column, allowed: Column, restricted: Column) -> Column:
    """Allowed edges win; else an edge is open if nothing is allowed by name and it is not restricted."""
    own, banned = F.coalesce(allowed, F.array().cast("array<long>")), F.coalesce(restricted, F.array().cast("array<long>"))
    return F.array_contains(own, edge) | ((F.size(own) == 0) & ~F.array_contains(banned, edge))


# Trips: legs are array<struct<ttf, stopping, constant, one..four, alpha, kind, tstar, beta, gamma, delta>>


def trip_utility(departure: Column, origin_delay: Column, legs: Column, total: dict[str, Column], origin: dict[str, Column], destination: dict[str, Column]) -> Column:
    """Utility of a trip that departs at ``departure``: the legs in order, then the polynomial of the whole travel time."""
    from wayfare.functions import pwl

    def leg(state: Column, x: Column) -> Column:
        def passed(spent: Column) -> Column:
            return pwl.bind(state["t"] + spent, lambda arrival: arrived(spent, arrival))

        def arrived(spent: Column, arrival: Column) -> Column:
            gain = travel_utility(spent, x["constant"], x["one"], x["two"], x["three"], x["four"], x["alpha"]) + schedule_utility(arrival, x["kind"], x["tstar"], x["beta"], x["gamma"], x["delta"])
            return F.struct((arrival + _zero(x["stopping"])).alias("t"), (state["u"] + gain).alias("u"), (state["travel"] + spent).alias("travel"), arrival.alias("arrival"))

        return pwl.bind(pwl.evaluate(x["ttf"], state["t"]), passed)

    def whole_trip(end: Column) -> Column:
        whole = travel_utility(end["travel"], total["constant"], total["one"], total["two"], total["three"], total["four"], total.get("alpha"))
        sides = schedule_utility(departure, *[origin[k] for k in ("kind", "tstar", "beta", "gamma", "delta")]) + schedule_utility(end["t"], *[destination[k] for k in ("kind", "tstar", "beta", "gamma", "delta")])
        return end["u"] + whole + sides

    start = departure + _zero(origin_delay)
    first = F.struct(start.alias("t"), F.lit(0.0).alias("u"), F.lit(0.0).alias("travel"), start.alias("arrival"))
    # the fold over the legs is read several times
    return pwl.bind(F.aggregate(legs, first, leg), whole_trip)
