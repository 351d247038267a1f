"""Route operators over tables of queries and edges.

A graph whose edges fit in a worker (checked: ``MOST_BYTES`` of edge data) is sent to the workers once, and queries run
there, one search for each row, or for each origin where several destinations are asked for.  Beyond that, ``relax`` finds the same
arrival times and routes by rounds of joins, with nothing sent.  The intersect operators are plain equi-joins on hubs.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.operators import rounds
from wayfare.operators.graph import Graph, Grid
from wayfare.operators.hierarchy import Hierarchy
from wayfare.sources.shared import cut, cut_sorted

MOST_BYTES = 256 << 20


def too_large(edges: DataFrame) -> bool:
    """Whether the edges with their functions take more than ``MOST_BYTES``."""
    size = edges.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size(F.col("ttf")["points"]), F.lit(1))).alias("points")).first()
    return 200 * size.n + 8 * (size.points or 0) > MOST_BYTES


def load_graph(edges: DataFrame) -> Graph:
    """The graph of (edge_id, source, target, ttf); fails if it is too large or its functions have different grids."""
    if too_large(edges):
        raise ValueError("the graph is too large for one worker; use relax")
    grids = edges.where("ttf.points is not null").select("ttf.start_x", "ttf.interval_x", F.size("ttf.points").alias("n")).distinct().limit(2).collect()
    if len(grids) > 1:
        raise ValueError("the travel-time functions do not have the same start, interval and size")
    grid = Grid(grids[0].start_x, grids[0].interval_x, grids[0].n) if grids else None
    rows = edges.select("edge_id", "source", "target", "ttf").orderBy("edge_id").collect()
    return Graph(((r.edge_id, r.source, r.target, np.array(r.ttf.points) if r.ttf.points is not None else r.ttf.cst) for r in rows), grid)


def algorithm(queries: int, sources: int, targets: int, nodes: int, simulator: bool = False) -> str:
    """The strategy that the sizes suggest; results are the same."""
    if not simulator and queries <= 100:
        return "Dijkstra"
    return "Intersect" if max(sources, targets) * (10 if simulator else 50) <= nodes else "TCH"


def algorithm_column(queries, sources, targets, nodes, simulator: bool = False):
    """``algorithm`` over rows of sizes."""
    many = F.when(F.greatest(sources, targets) * (10 if simulator else 50) <= nodes, "Intersect").otherwise("TCH")
    return many if simulator else F.when(queries <= 100, "Dijkstra").otherwise(many)


def _spread(searches: DataFrame, *keys: str) -> DataFrame:
    """One search a row, dealt over all tasks: rows so small would come in one partition."""
    return searches.repartition(max(1, int(searches.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _types(edges: DataFrame) -> tuple[str, str]:
    kinds = dict(edges.dtypes)
    return kinds["source"], kinds["edge_id"]


def one_to_all(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """origin, departure_time, node, arrival_time of all nodes that (origin, departure_time) reach."""
    node, _ = _types(edges)
    graph = edges.sparkSession.sparkContext.broadcast(load_graph(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, departure in zip(batch["origin"], batch["departure_time"], strict=True):
                arrival, _ = graph.value.earliest(origin, departure)
                yield pd.DataFrame({"origin": origin, "departure_time": departure, "node": list(arrival), "arrival_time": list(arrival.values())})

    return _spread(queries.select("origin", "departure_time").distinct()).mapInPandas(run, f"origin {node}, departure_time double, node {node}, arrival_time double")


_ANSWER = "query_id {query}, origin {node}, destination {node}, departure_time double, arrival_time double, route array<{edge}>, seconds double"


def _answers(queries: DataFrame, edges: DataFrame, found, with_route: bool) -> DataFrame:
    """``found()`` is a search (origin, destination, departure) → (arrival, route) or None of the worker."""
    node, edge = _types(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = found()
        for batch in batches:
            arrivals, routes, seconds = [], [], []
            for o, t, x in zip(batch["origin"], batch["destination"], batch["departure_time"], strict=True):
                began = time.perf_counter()
                way = search(o, t, x)
                seconds.append(time.perf_counter() - began)
                arrivals.append(way[0] if way else None)
                routes.append(way[1] if way and with_route else None)
            out = batch[["query_id", "origin", "destination", "departure_time"]].copy()
            out["arrival_time"] = pd.Series(arrivals, dtype="float64", index=out.index)
            out["route"] = pd.Series(routes, dtype=object, index=out.index)
            out["seconds"] = pd.Series(seconds, dtype="float64", index=out.index)
            yield out

    kept = queries.select("query_id", "origin", "destination", F.col("departure_time").cast("double").alias("departure_time"))
    out = _spread(kept).mapInPandas(run, _ANSWER.format(query=dict(queries.dtypes)["query_id"], node=node, edge=edge))
    return out.withColumn("arrival_time", F.nanvl("arrival_time", F.lit(None).cast("double")))


def earliest_arrivals(queries: DataFrame, edges: DataFrame, with_route: bool = True, by_rounds: bool = False) -> DataFrame:
    """query_id, origin, destination, departure_time, arrival_time, route, seconds; the last three null if there is no way (of rounds of joins,
    seconds are never known)."""
    if by_rounds or too_large(edges):
        return rounds.arrivals_by_rounds(queries, edges, with_route).withColumn("seconds", F.lit(None).cast("double"))
    graph = edges.sparkSession.sparkContext.broadcast(load_graph(edges))
    return _answers(queries, edges, lambda: graph.value.earliest_route, with_route)


def hierarchy_arrivals(queries: DataFrame, edges: DataFrame, hierarchy: Hierarchy, with_route: bool = True) -> DataFrame:
    """The same over a contraction hierarchy of the edges; routes are unpacked."""
    sent = edges.sparkSession.sparkContext.broadcast(hierarchy)  # of a graph that load_graph checked

    def found():
        known = sent.value.order
        return lambda o, t, x: sent.value.earliest_route(o, t, x) if o in known and t in known else (x, []) if o == t else None

    return _answers(queries, edges, found, with_route)


def two_way_costs(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """The same on constants, each query searched from both ends by turns."""
    graph = edges.sparkSession.sparkContext.broadcast(load_graph(edges))

    def found():
        def search(o, t, x):
            way = graph.value.two_way(o, t)
            return (x + way[0], way[1]) if way else None

        return search

    return _answers(queries, edges, found, True)


def reached_from(starts: DataFrame, edges: DataFrame, bound: float = float("inf"), hops: int | None = None) -> DataFrame:
    """query_id, node, arrival_time of nodes reached from any start (query_id, node, arrival_time) of a query, before ``bound`` and over at most ``hops`` edges."""
    node, _ = _types(edges)
    graph = edges.sparkSession.sparkContext.broadcast(load_graph(edges))
    listed = starts.groupBy("query_id").agg(F.collect_list(F.struct("node", "arrival_time")).alias("starts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, own in zip(batch["query_id"], batch["starts"], strict=True):
                reached, _ = graph.value.earliest_from({r["node"]: r["arrival_time"] for r in own}, bound=bound, hops=hops)
                yield pd.DataFrame({"query_id": query, "node": list(reached), "arrival_time": list(reached.values())})

    return _spread(listed).mapInPandas(run, f"query_id {dict(starts.dtypes)['query_id']}, node {node}, arrival_time double")


def interval_bounds(origins: DataFrame, edges: DataFrame) -> DataFrame:
    """origin, node, least, greatest: bounds of the travel time at any departure."""
    node, _ = _types(edges)
    graph = edges.sparkSession.sparkContext.broadcast(load_graph(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin in batch["origin"]:
                label, _ = graph.value.intervals(origin)
                yield pd.DataFrame([(origin, n, low, high) for n, (low, high) in label.items()], columns=["origin", "node", "least", "greatest"])

    return _spread(origins.select("origin").distinct()).mapInPandas(run, f"origin {node}, node {node}, least double, greatest double")


def profiles(pairs: DataFrame, edges: DataFrame, by_rounds: bool = False) -> DataFrame:
    """origin, destination, ttf (null if there is no way): one search for each origin and all of its destinations, beyond one worker by rounds of joins.

    The destinations of an origin come in order, in lists of at most 1024 that are searched together; only an origin with more than that has
    a second search.
    """
    if by_rounds or too_large(edges):
        return rounds.profiles_by_rounds(pairs, edges)
    graph = edges.sparkSession.sparkContext.broadcast(load_graph(edges))
    return _profiles(pairs, edges, lambda: (graph.value.grid, graph.value.profile))


def hierarchy_profiles(pairs: DataFrame, edges: DataFrame, hierarchy: Hierarchy) -> DataFrame:
    """The same over a contraction hierarchy, one search for each pair."""
    sent = edges.sparkSession.sparkContext.broadcast(hierarchy)

    def found():
        h = sent.value
        return h.graph.grid, lambda o, wanted: {t: f for t in wanted if o in h.order and t in h.order and (f := h.profile(o, t)) is not None}

    return _profiles(pairs, edges, found)


def _profiles(pairs: DataFrame, edges: DataFrame, found, most: int = 1024) -> DataFrame:
    node, _ = _types(edges)
    distinct = pairs.select("origin", "destination").distinct()
    parts = distinct.groupBy("origin").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    targets = distinct.join(parts, "origin").withColumn("part", F.pmod(F.xxhash64("destination"), F.col("parts"))).groupBy("origin", "part").agg(F.sort_array(F.collect_list("destination")).alias("targets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _profile_frames(batches, *found())

    schema = f"origin {node}, destination {node}, start_x double, interval_x double, points array<double>, cst double"
    out = _spread(targets).mapInPandas(run, schema)
    ttf = F.struct(F.nanvl("start_x", F.lit(None)).alias("start_x"), F.nanvl("interval_x", F.lit(None)).alias("interval_x"), "points", F.nanvl("cst", F.lit(None)).alias("cst")).cast(pwl.TYPE)
    return out.select("origin", "destination", F.when(F.col("points").isNull() & F.nanvl("cst", F.lit(None)).isNull(), None).otherwise(ttf).alias("ttf"))


def _profile_frames(batches: Iterator[pd.DataFrame], grid: Grid | None, search, rows_of_a_frame: int = 4096) -> Iterator[pd.DataFrame]:
    """The functions of many origins in one frame: a frame for each would cost more than its search."""
    rows: list[tuple] = []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["origin", "destination", "start_x", "interval_x", "points", "cst"])

    for batch in batches:
        for origin, wanted in zip(batch["origin"], batch["targets"], strict=True):
            functions = search(origin, set(wanted))
            rows += [(origin, t, *_parts(0.0 if t == origin else functions.get(t), grid)) for t in wanted]
            if len(rows) >= rows_of_a_frame:
                yield frame()
                rows = []
    if rows:
        yield frame()


def _parts(f, grid: Grid | None) -> tuple:
    if f is None:
        return None, None, None, None
    if np.ndim(f) == 0:
        return None, None, None, float(f)
    if np.all(f == f[0]):
        return None, None, None, float(f[0])
    return grid.start, grid.interval, f.tolist(), None


def relax(starts: DataFrame, edges: DataFrame, most_rounds: int = 10_000, wanted: DataFrame | None = None) -> DataFrame:
    """query_id, node, arrival_time, last_edge, last_node of everything that the starts (query_id, node, arrival_time) reach, by rounds of joins.

    Only labels that improved move in a round.  Known labels lie in sorted buckets and are not rewritten but joined in
    place; the improvements of single rounds are merged into them once they are a fourth as many.  With ``wanted`` (query_id, node)
    a label that is no earlier than the latest wanted arrival of its query, all of them being known, moves no further.
    """
    ways = edges.select("edge_id", "source", "target", "ttf").where("ttf.points is not null or ttf.cst < double('infinity')")
    node, edge = _types(edges)
    first = starts.groupBy("query_id", "node").agg(F.min("arrival_time").alias("arrival_time"))
    label = ["query_id", "node", "arrival_time", "last_edge", "last_node"]
    base = cut_sorted(first.select("query_id", "node", "arrival_time", F.lit(None).cast(edge).alias("last_edge"), F.lit(None).cast(node).alias("last_node")), "labels", "query_id", "node")
    frontier, recent, size, extra = base, [], base.count(), 0
    best = None if wanted is None else cut(wanted.distinct(), "wanted")

    def least(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for other in parts[1:]:
            out = out.unionByName(other)
        return out.groupBy("query_id", "node").agg(F.min(F.struct("arrival_time", "last_edge", "last_node")).alias("x")).select("query_id", "node", "x.*")

    for _ in range(most_rounds):
        moving = frontier
        if best is not None:
            known = least([base.join(best, ["query_id", "node"], "left_semi"), *[r.join(best, ["query_id", "node"], "left_semi") for r in recent]])
            limits = best.join(known.select("query_id", "node", "arrival_time"), ["query_id", "node"], "left").groupBy("query_id").agg(F.max("arrival_time").alias("limit"), F.count_if(F.col("arrival_time").isNull()).alias("missing"))
            moving = frontier.join(limits.where("missing = 0").select("query_id", "limit"), "query_id", "left").where("limit is null or arrival_time < limit").drop("limit")
        moved = moving.select("query_id", F.col("node").alias("last_node"), "arrival_time").join(ways, F.col("last_node") == F.col("source"))
        at = F.col("arrival_time") + pwl.evaluate(F.col("ttf"), F.col("arrival_time"))
        reached = least([moved.select("query_id", F.col("target").alias("node"), at.alias("arrival_time"), F.col("edge_id").alias("last_edge"), "last_node")])
        for held in (base, *recent):
            old = held.select("query_id", "node", F.col("arrival_time").alias("old_time"))
            reached = reached.join(old, ["query_id", "node"], "left").where("old_time is null or arrival_time < old_time").drop("old_time")
        frontier = cut(reached.select(*label), "frontier")
        new = frontier.count()
        if not new:
            return least([base, *recent]) if recent else base
        recent.append(frontier)
        extra += new
        if 4 * extra > size or len(recent) >= 8:
            base = cut_sorted(least([base, *recent]), "labels", "query_id", "node")
            recent, size, extra = [], base.count(), 0
    raise RuntimeError("labels did not settle")


# --- search spaces and their intersection --------------------------------------------------


def build_hierarchy(edges: DataFrame, order: dict | None = None, weights: tuple[float, float, float, float] = (2, 1, 1, 2), hops: int = 16) -> Hierarchy:
    """On the driver, of a graph that fits there (checked); once for all that is asked of it."""
    return Hierarchy(load_graph(edges), order, weights, hops)


def search_spaces(nodes: DataFrame, edges: DataFrame, forward: bool, hierarchy: Hierarchy | None = None) -> DataFrame:
    """node, hub, ttf: from each node up to its hubs, or from its hubs down to it, in a contraction hierarchy."""
    node, _ = _types(edges)
    sent = edges.sparkSession.sparkContext.broadcast(hierarchy or build_hierarchy(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = sent.value
        for batch in batches:
            for n in batch["node"]:
                if n in h.order:
                    space = h.forward_space(n) if forward else h.backward_space(n)
                    yield pd.DataFrame([(n, hub, *_parts(f, h.graph.grid)) for hub, f in space.items()], columns=["node", "hub", "start_x", "interval_x", "points", "cst"])

    out = _spread(nodes.select("node").distinct()).mapInPandas(run, f"node {node}, hub {node}, start_x double, interval_x double, points array<double>, cst double")
    none = F.lit(None).cast("double")
    return out.select("node", "hub", F.struct(F.nanvl("start_x", none).alias("start_x"), F.nanvl("interval_x", none).alias("interval_x"), "points", F.nanvl("cst", none).alias("cst")).cast(pwl.TYPE).alias("ttf"))


def intersect_arrivals(queries: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """query_id, arrival_time: least t + f(t) + g(t + f(t)) over common hubs; queries without one are absent."""
    up = queries.join(forward.select(F.col("node").alias("origin"), "hub", F.col("ttf").alias("f")), "origin")
    at_hub = up.select("query_id", "destination", "hub", (F.col("departure_time") + pwl.evaluate(F.col("f"), F.col("departure_time"))).alias("at"))
    down = at_hub.join(backward.select(F.col("node").alias("destination"), "hub", F.col("ttf").alias("g")), ["destination", "hub"])
    return down.groupBy("query_id").agg(F.min(F.col("at") + pwl.evaluate(F.col("g"), F.col("at"))).alias("arrival_time"))


def intersect_profiles(pairs: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """origin, destination, ttf: pointwise least link over common hubs; hubs that cannot win by their bounds are left out first."""
    f = forward.select(F.col("node").alias("origin"), "hub", F.col("ttf").alias("f"))
    g = backward.select(F.col("node").alias("destination"), "hub", F.col("ttf").alias("g"))
    both = pairs.select("origin", "destination").distinct().join(f, "origin").join(g, ["destination", "hub"])
    low, high = pwl.least(F.col("f")) + pwl.least(F.col("g")), pwl.greatest(F.col("f")) + pwl.greatest(F.col("g"))
    best = F.min(high).over(Window.partitionBy("origin", "destination"))
    linked = both.withColumn("best", best).where(low <= F.col("best")).select("origin", "destination", pwl.link(F.col("f"), F.col("g")).alias("h"))
    lowest = linked.groupBy("origin", "destination").agg(F.min(F.when(pwl.is_constant(F.col("h")), F.col("h")["cst"])).alias("cst"), F.max("h.start_x").alias("start_x"), F.max("h.interval_x").alias("interval_x"))
    points = linked.where("h.points is not null").select("origin", "destination", F.posexplode("h.points").alias("k", "y")).groupBy("origin", "destination", "k").agg(F.min("y").alias("y"))
    rows = points.groupBy("origin", "destination").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "y"))), lambda p: p["y"]).alias("ys"))
    joined = lowest.join(rows, ["origin", "destination"], "left")
    capped = F.transform("ys", lambda y: F.least(y, F.col("cst")))
    return joined.select("origin", "destination", F.when(F.col("ys").isNull(), pwl.constant(F.col("cst"))).otherwise(pwl.from_values(F.col("start_x"), F.col("interval_x"), capped)).cast(pwl.TYPE).alias("ttf"))
