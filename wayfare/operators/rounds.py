"""Searches by rounds of joins, for graphs of any size and many departures at once.

A label is the vector of the arrival times at a node for all departures of one start.  A round moves the labels that the last one
lowered over their edges, each time by its own value of the edge's function, and takes lesser values place by place; on first-in
first-out functions what no round lowers is the earliest arrival of each departure.  Legs of one origin, and the points of a
profile's grid, thus share their joins, and no task holds a graph.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.sources.shared import cut, cut_sorted

#: Departures of a start's vector; queries of one origin are cut into as many starts as that takes.
MOST_DEPARTURES = 128


def _at(value: Column, with_last: bool) -> Column:
    return value["at"] if with_last else value


def _least(rows: DataFrame) -> DataFrame:
    """One label for each query_id and node: the lesser values place by place."""
    folded = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(1))), F.get("xs", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: F.least(p, q)))
    return rows.groupBy("query_id", "node").agg(F.collect_list("arrivals").alias("xs")).select("query_id", "node", folded.alias("arrivals"))


def relax_vectors(starts: DataFrame, edges: DataFrame, with_last: bool = False, wanted: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """query_id, node, arrivals of all nodes that starts (query_id, node, departures: array<double>) reach.

    ``arrivals`` has a time for each departure, or with ``with_last`` a struct of that time (at), the last edge and the node before (edge, last; null at the
    start).  Known labels lie in sorted buckets and are joined in place; what single rounds lowered is merged into them once it is a fourth as
    much.  With ``wanted`` (query_id, node) a label goes no further that is for no departure earlier than the latest wanted arrival, once all are known.
    """
    ways = edges.select("edge_id", "source", "target", "ttf").where("ttf.points is not null or ttf.cst < double('infinity')")
    kinds = dict(edges.dtypes)

    def label(at: Column, edge: Column, last: Column) -> Column:
        return F.struct(at.alias("at"), edge.cast(kinds["edge_id"]).alias("edge"), last.cast(kinds["source"]).alias("last")) if with_last else at

    none = F.lit(None)
    first = _least(starts.select("query_id", "node", F.transform("departures", lambda t: label(t.cast("double"), none, none)).alias("arrivals")))
    base = cut_sorted(first, "vectors", "query_id", "node")
    frontier, recent, size, extra = base, [], base.count(), 0
    best = None if wanted is None else cut(wanted.distinct(), "wanted")
    for _ in range(rounds):
        moving = frontier
        if best is not None:
            held = base.join(best, ["query_id", "node"], "left_semi")
            for r in recent:
                held = held.unionByName(r.join(best, ["query_id", "node"], "left_semi"))
            known = best.join(_least(held), ["query_id", "node"], "left").select("query_id", F.transform("arrivals", lambda x: _at(x, with_last)).alias("ts"))
            latest = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), F.get("all", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: F.greatest(p, q)))
            limits = known.groupBy("query_id").agg(F.collect_list("ts").alias("all"), F.count_if(F.col("ts").isNull()).alias("missing")).where("missing = 0").select("query_id", latest.alias("limit"))
            early = F.exists(F.zip_with("arrivals", "limit", lambda x, y: _at(x, with_last) < y), lambda b: b)
            moving = frontier.join(limits, "query_id", "left").where(F.col("limit").isNull() | early).drop("limit")
        moved = moving.select("query_id", F.col("node").alias("before"), "arrivals").join(ways, F.col("before") == F.col("source"))
        onward = F.transform("arrivals", lambda x: label(_at(x, with_last) + pwl.evaluate(F.col("ttf"), _at(x, with_last)), F.col("edge_id"), F.col("before")))
        reached = _least(moved.select("query_id", F.col("target").alias("node"), onward.alias("arrivals")))
        for held in (base, *recent):
            old = held.select("query_id", "node", F.col("arrivals").alias("old"))
            lower = F.exists(F.zip_with("arrivals", "old", lambda x, y: _at(x, with_last) < _at(y, with_last)), lambda b: b)
            joined = reached.join(old, ["query_id", "node"], "left").where(F.col("old").isNull() | lower)
            kept = F.zip_with("arrivals", "old", lambda x, y: F.when(_at(x, with_last) < _at(y, with_last), x).otherwise(y))
            reached = joined.select("query_id", "node", F.when(F.col("old").isNull(), F.col("arrivals")).otherwise(kept).alias("arrivals"))
        frontier = cut(reached, "frontier")
        new = frontier.count()
        if not new:
            return _newest(base, recent)
        recent.append(frontier)
        extra += new
        if 4 * extra > size or len(recent) >= 6:
            base = cut_sorted(_newest(base, recent), "vectors", "query_id", "node")
            recent, size, extra = [], base.count(), 0
    raise RuntimeError("labels did not settle")


def _newest(base: DataFrame, recent: list[DataFrame]) -> DataFrame:
    """What the last round that lowered a label made of it, which holds all lesser values of those before."""
    if not recent:
        return base
    rows = base.withColumn("round", F.lit(0))
    for k, r in enumerate(recent):
        rows = rows.unionByName(r.withColumn("round", F.lit(k + 1)))
    return rows.groupBy("query_id", "node").agg(F.max_by("arrivals", "round").alias("arrivals"))


def grouped_queries(queries: DataFrame, slot: float = 3600.0, most: int = MOST_DEPARTURES) -> DataFrame:
    """The queries (origin, departure_time, ...) with ``group_id``, one of an origin and a slot of time, its sorted ``departures`` and their place ``k`` in them.

    A group has some ``most`` different departures; an origin and slot with more has several groups.
    """
    keyed = queries.withColumn("slot", F.floor(F.col("departure_time") / slot))
    different = keyed.select("origin", "slot", "departure_time").distinct()
    counted = different.groupBy("origin", "slot").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("departure_time"), F.col("parts"))
    dealt = different.join(counted, ["origin", "slot"]).withColumn("group_id", F.concat_ws("|", F.col("origin").cast("string"), F.col("slot").cast("string"), part.cast("string")))
    listed = dealt.groupBy("group_id").agg(F.sort_array(F.collect_list("departure_time")).alias("departures"))
    placed = dealt.join(listed, "group_id").withColumn("k", (F.array_position("departures", F.col("departure_time")) - 1).cast("int"))
    return keyed.join(placed.select("origin", "slot", "departure_time", "group_id", "departures", "k"), ["origin", "slot", "departure_time"]).drop("slot")


def arrivals_by_rounds(queries: DataFrame, edges: DataFrame, with_route: bool) -> DataFrame:
    """query_id, origin, destination, departure_time, arrival_time, route (null if not asked for or there is no way) of queries; those of one origin and hour share their search."""
    edge = dict(edges.dtypes)["edge_id"]
    asked = cut(grouped_queries(queries.select("query_id", "origin", "destination", F.col("departure_time").cast("double").alias("departure_time"))), "asked")
    starts = asked.select(F.col("group_id").alias("query_id"), F.col("origin").alias("node"), "departures").dropDuplicates(["query_id"])
    labels = cut(relax_vectors(starts, edges, with_route, asked.select(F.col("group_id").alias("query_id"), F.col("destination").alias("node"))), "labels")
    reached = labels.select(F.col("query_id").alias("group_id"), F.col("node").alias("destination"), F.col("arrivals"))
    met = asked.drop("departures").join(reached, ["group_id", "destination"], "left")
    out = met.select("query_id", "group_id", "k", "origin", "destination", "departure_time", _at(F.get("arrivals", F.col("k")), with_route).alias("arrival_time"))
    if not with_route:
        return out.select("query_id", "origin", "destination", "departure_time", "arrival_time", F.lit(None).cast(f"array<{edge}>").alias("route"))
    steps = labels.select(F.col("query_id").alias("group_id"), "node", F.posexplode("arrivals").alias("k", "x")).where("x.edge is not null").select("group_id", "k", "node", F.col("x.last").alias("up"), F.col("x.edge").alias("edge_id"))
    ends = out.where("arrival_time is not null").select("group_id", "k", F.col("destination").alias("node")).distinct()
    routes = routes_back(ends, cut(steps, "steps"), ["group_id", "k"]).withColumnRenamed("node", "destination")
    empty = F.array().cast(f"array<{edge}>")
    joined = out.join(routes, ["group_id", "k", "destination"], "left")
    return joined.select("query_id", "origin", "destination", "departure_time", "arrival_time", F.when(F.col("arrival_time").isNotNull(), F.coalesce("route", empty)).alias("route"))


def routes_back(ends: DataFrame, steps: DataFrame, keys: list[str], most: int = 64) -> DataFrame:
    """keys, node, route: from each end (keys, node) over the steps (keys, node, up, edge_id) to where there is none, in log2(length) + 1 rounds each way.

    Level i of the jumps leads 2^i steps up; going through the levels from the highest down, each end marks every node of its route once, with the
    number of steps to it, which puts the edges in order.
    """
    jumps = [steps.select(*keys, "node", "up")]
    for _ in range(most):
        half = jumps[-1]
        onward = half.select(*keys, F.col("node").alias("up"), F.col("up").alias("further"))
        level = cut(half.join(onward, [*keys, "up"]).select(*keys, "node", F.col("further").alias("up")), "jumps")
        if level.isEmpty():
            break
        jumps.append(level)
    else:
        raise RuntimeError("a route does not end")
    marks = ends.select(*keys, F.col("node").alias("end"), "node", F.lit(0).cast("long").alias("far"))
    for i in reversed(range(len(jumps))):
        up = marks.join(jumps[i], [*keys, "node"]).select(*keys, "end", F.col("up").alias("node"), (F.col("far") + (1 << i)).alias("far"))
        marks = cut(marks.unionByName(up), "marks")
    on_way = marks.join(steps, [*keys, "node"]).groupBy(*keys, "end").agg(F.sort_array(F.collect_list(F.struct("far", "edge_id")), asc=False).alias("way"))
    return on_way.select(*keys, F.col("end").alias("node"), F.transform("way", lambda x: x["edge_id"]).alias("route"))


def profiles_by_rounds(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """origin, destination, ttf (null if there is no way) on the edges' grid: one search from each origin, all points of the grid together."""
    grids = edges.where("ttf.points is not null").select("ttf.start_x", "ttf.interval_x", F.size("ttf.points").alias("n")).distinct().limit(2).collect()
    if len(grids) > 1:
        raise ValueError("the travel-time functions do not have the same start, interval and size")
    start, step, n = (grids[0].start_x, grids[0].interval_x, grids[0].n) if grids else (0.0, 1.0, 1)
    xs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(start) + k * F.lit(step))
    different = cut(pairs.select("origin", "destination").distinct(), "pairs")
    starts = different.select(F.col("origin").alias("query_id"), F.col("origin").alias("node")).distinct().withColumn("departures", xs)
    labels = relax_vectors(starts, edges, wanted=different.select(F.col("origin").alias("query_id"), F.col("destination").alias("node")))
    met = different.join(labels.select(F.col("query_id").alias("origin"), F.col("node").alias("destination"), "arrivals"), ["origin", "destination"], "left")
    spent = F.zip_with("arrivals", xs, lambda at, x: at - x)
    # sums of one route differ in their last digits by the departure: as constant as the rounding
    level = F.array_max(spent) - F.array_min(spent) <= 1e-9 * (1 + F.lit(abs(start) + abs(step) * n))
    made = F.when(level, pwl.constant(F.get(spent, F.lit(0)))).otherwise(pwl.piecewise(F.lit(start), F.lit(step), spent))
    return met.select("origin", "destination", F.when(F.col("arrivals").isNotNull(), made.cast(pwl.TYPE)).alias("ttf"))
