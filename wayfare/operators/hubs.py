"""Hub labels of a network with functions of time, built by rounds of joins.

Nodes have a rank by hash and degree.  A node's labels are the hubs it can go to (``out``) and come from (``in``) over nodes that all have a lower
rank than the hub, with the exact arrival function of the best such way.  On the fastest way between two nodes, at any departure, the
node of highest rank is a hub of both ends, so that the least link over common hubs is the answer, exact at every time.

Each round moves the labels that the last one lowered over one edge, drops those that a higher hub covers at all times (an anti-join
by bounds against the labels known), and keeps the pointwise lesser function.  Labels are a table: nothing is
collected, no task holds a graph.  A function is a list of breakpoints with times of arrival, exact under linking and
lesser-of for functions that are first-in first-out; numpy links and compares single functions within tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import pwl
from wayfare.sources.shared import cut

#: Seconds by which a function must be lower somewhere to count as lower.
MARGIN = 1e-9
#: Breakpoints that the labels of a round may have where a search can answer as well; a label counts as ``LABEL_SIZE`` of them at least.
MOST_POINTS = 10_000_000
LABEL_SIZE = 100
_RANK = pa.struct([("p", pa.float64()), ("h", pa.int32())])


def arrivals_at(xs: np.ndarray, ys: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Arrival times at departures t: linear between breakpoints, of constant travel time outside of them."""
    out = np.interp(t, xs, ys)
    out = np.where(t < xs[0], t + (ys[0] - xs[0]), out)
    return np.where(t > xs[-1], t + (ys[-1] - xs[-1]), out)


def _simple(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without points on the line of their neighbours, and outer ones of the constant travel time that holds outside."""
    spent = ys - xs
    changes = np.flatnonzero(np.abs(np.diff(spent)) > 1e-10)
    if not len(changes):
        return xs[:1], ys[:1]
    xs, ys = xs[changes[0] : changes[-1] + 2], ys[changes[0] : changes[-1] + 2]
    if len(xs) > 2:
        gap = np.maximum(xs[2:] - xs[:-2], 1e-12)
        line = ys[:-2] + (xs[1:-1] - xs[:-2]) / gap * (ys[2:] - ys[:-2])
        keep = np.concatenate([[True], np.abs(line - ys[1:-1]) > 1e-10, [True]])
        xs, ys = xs[keep], ys[keep]
    return xs, ys


def link(fx: np.ndarray, fy: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First f, then g."""
    back = np.interp(gx, fy, fx)
    back = np.where(gx < fy[0], gx - (fy[0] - fx[0]), back)
    back = np.where(gx > fy[-1], gx - (fy[-1] - fx[-1]), back)
    xs = np.unique(np.concatenate([fx, back]))
    return _simple(xs, arrivals_at(gx, gy, arrivals_at(fx, fy, xs)))


def lesser(fx: np.ndarray, fy: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pointwise lesser of two functions, and whether g is lower than f anywhere."""
    xs = np.unique(np.concatenate([fx, gx]))
    d = arrivals_at(fx, fy, xs) - arrivals_at(gx, gy, xs)
    if not (d > MARGIN).any():
        return fx, fy, False
    if (d >= 0).all():
        return gx, gy, True
    k = np.flatnonzero(d[:-1] * d[1:] < 0)
    xs = np.unique(np.concatenate([xs, xs[k] + (xs[k + 1] - xs[k]) * d[k] / (d[k] - d[k + 1])]))
    return *_simple(xs, np.minimum(arrivals_at(fx, fy, xs), arrivals_at(gx, gy, xs))), True


def _rows(batch: pa.RecordBatch, *names: str) -> list[list[np.ndarray]]:
    """The list columns as arrays of numbers, row by row."""
    out = []
    for name in names:
        column = batch[name]
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        out.append([values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return out


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels moved over an edge: behind an ``in`` label, before an ``out`` label."""
    for batch in batches:
        made = [link(fx, fy, gx, gy) if way == "in" else link(gx, gy, fx, fy) for way, fx, fy, gx, gy in zip(batch["way"].to_pylist(), *_rows(batch, "xs", "ys", "ex", "ey"), strict=True)]
        spent = [ys - xs for xs, ys in made]
        columns = [batch[c] for c in ("way", "hub", "node", "hub_rank")] + [pa.array([x for x, _ in made], pa.list_(pa.float64())), pa.array([y for _, y in made], pa.list_(pa.float64()))]
        columns += [pa.array([float(s.min()) for s in spent], pa.float64()), pa.array([float(s.max()) for s in spent], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["way", "hub", "node", "hub_rank", "xs", "ys", "low", "high"])


def _least_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each way, hub and node, which come together, the known label first: the lesser of all, if it is lower than that."""
    key, xs, ys, new, rank = None, None, None, False, None

    def result(done: list) -> pa.RecordBatch:
        spent = [y - x for _, _, x, y in done]
        arrays = [pa.array([k[0] for k, *_ in done], pa.string()), pa.array([k[1] for k, *_ in done]), pa.array([k[2] for k, *_ in done]), pa.array([r for _, r, _, _ in done], _RANK)]
        arrays += [pa.array([x for _, _, x, _ in done], pa.list_(pa.float64())), pa.array([y for *_, y in done], pa.list_(pa.float64()))]
        arrays += [pa.array([float(s.min()) for s in spent], pa.float64()), pa.array([float(s.max()) for s in spent], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=["way", "hub", "node", "hub_rank", "xs", "ys", "low", "high"])

    for batch in batches:
        done = []
        fxs, fys = _rows(batch, "xs", "ys")
        for way, hub, node, known, own, fx, fy in zip(batch["way"].to_pylist(), batch["hub"].to_pylist(), batch["node"].to_pylist(), batch["known"].to_pylist(), batch["hub_rank"].to_pylist(), fxs, fys, strict=True):
            if (way, hub, node) == key:
                xs, ys, lower = lesser(xs, ys, fx, fy)
                new = new or lower
                continue
            if new:
                done.append((key, rank, xs, ys))
            key, xs, ys, new, rank = (way, hub, node), fx, fy, not known, own
        if done:
            yield result(done)
    if new:
        yield result([(key, rank, xs, ys)])


def _ranks(edges: DataFrame) -> DataFrame:
    """node, rank: a uniform draw by hash with as many tries as the node has edges; the least rank is the highest."""
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    draw = (F.xxhash64(F.col("node"), F.lit(7)).cast("double") / 2.0**64 + 0.5) * (1 - 1e-12) + 1e-13
    return ends.groupBy("node").agg(F.count("*").alias("n")).select("node", F.struct((-F.log(draw) / F.col("n")).alias("p"), F.hash("node").alias("h")).alias("rank"))


def _given(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Ranks of a given order; nodes that it does not name come last of all."""
    listed = order.select(F.col("node_id").alias("node"), (-F.col("order").cast("double")).alias("p"))
    return _ranks(edges).join(listed, "node", "left").select("node", F.struct(F.coalesce("p", F.lit(float("inf"))).alias("p"), F.hash("node").alias("h")).alias("rank"))


def _covered(labels: DataFrame, known: DataFrame) -> DataFrame:
    """way, hub, node of labels that a higher hub covers at any departure: its two legs at their slowest are no slower than the label at its fastest."""
    part = known.where("hub <> node").select("way", F.col("hub").alias("over"), F.col("hub_rank").alias("over_rank"), F.col("node"), F.col("high").alias("leg"))
    ins, outs = part.where("way = 'in'").drop("way"), part.where("way = 'out'").drop("way")
    # an out label node -> hub by way of node -> over -> hub; an in label hub -> node by way of hub -> over -> node
    first = labels.select("way", "hub", "node", "hub_rank", "low", F.when(F.col("way") == "out", F.col("node")).otherwise(F.col("hub")).alias("a"), F.when(F.col("way") == "out", F.col("hub")).otherwise(F.col("node")).alias("b"))
    one = first.join(outs.select(F.col("node").alias("a"), "over", "over_rank", F.col("leg").alias("leg1")), "a").where("over_rank < hub_rank and leg1 <= low")
    two = one.join(ins.select(F.col("node").alias("b"), "over", F.col("leg").alias("leg2")), ["b", "over"]).where("leg1 + leg2 <= low")
    return two.select("way", "hub", "node").distinct()


def _points(labels: DataFrame) -> int:
    return labels.agg(F.sum(F.greatest(F.size("xs"), F.lit(LABEL_SIZE)))).first()[0] or 0


def hub_labels(edges: DataFrame, order: DataFrame | None = None, rounds: int = 10_000, most: int | None = None) -> DataFrame | None:
    """way (out: node to hub, in: hub to node), hub, node, xs, ys (breakpoints and arrivals), low, high (bounds of the travel time) of a network (edge_id, source, target, ttf).

    Edges that are never passed are left out; of parallel edges the lesser function counts.  Functions must be first-in first-out.
    ``order`` (node_id, order) gives the ranks, the highest last; without it they are drawn by hash and degree.  A network without small separators
    has labels that grow with the square of its nodes: with ``most`` breakpoints given, None is returned once a round has more of them.
    """
    kinds = dict(edges.dtypes)
    open_edges = edges.where("ttf.points is not null or ttf.cst < double('infinity')")
    ranks = cut(_ranks(open_edges) if order is None else _given(open_edges, order), "ranks")
    grid = F.transform("ttf.points", lambda y, k: F.col("ttf.start_x") + k * F.col("ttf.interval_x"))
    xs = F.coalesce(grid, F.array(F.lit(0.0)))
    ys = F.coalesce(F.transform("ttf.points", lambda y, k: F.col("ttf.start_x") + k * F.col("ttf.interval_x") + y), F.array(F.col("ttf.cst")))
    shaped = open_edges.select("source", "target", xs.alias("ex"), ys.alias("ey"))
    both = shaped.select(F.lit("out").alias("way"), F.col("target").alias("at"), F.col("source").alias("to"), "ex", "ey").unionByName(shaped.select(F.lit("in").alias("way"), F.col("source").alias("at"), F.col("target").alias("to"), "ex", "ey"))
    ways = cut(both.join(ranks.select(F.col("node").alias("to"), F.col("rank").alias("to_rank")), "to"), "ways")
    zero = F.array(F.lit(0.0))
    own = ranks.select(F.explode(F.array(F.lit("out"), F.lit("in"))).alias("way"), F.col("node").alias("hub"), "node", F.col("rank").alias("hub_rank"), zero.alias("xs"), zero.alias("ys"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    known = cut(own, "hub_labels")
    frontier = known
    keys, label = ["way", "hub", "node"], ["way", "hub", "node", "hub_rank", "xs", "ys", "low", "high"]
    schema = known.schema
    for _ in range(rounds):
        moved = frontier.withColumnRenamed("node", "at").join(ways, ["way", "at"]).where("to_rank > hub_rank").select("way", "hub", F.col("to").alias("node"), "hub_rank", "xs", "ys", "ex", "ey")
        linked = cut(moved.mapInArrow(_link_rows, schema), "linked")
        if most is not None and _points(linked) + _points(known) > most:
            return None
        fresh = linked.join(_covered(linked, known), keys, "left_anti")
        before = known.join(fresh.select(*keys).distinct(), keys, "left_semi")
        together = before.select(*label, F.lit(True).alias("known")).unionByName(fresh.select(*label, F.lit(False).alias("known")))
        lower = together.repartition(*keys).sortWithinPartitions(*keys, F.col("known").desc()).mapInArrow(_least_rows, schema)
        frontier = cut(lower, "frontier")
        if frontier.isEmpty():
            return known.join(_covered(known.where("hub <> node"), known), keys, "left_anti").drop("hub_rank")
        known = cut(known.join(frontier.select(*keys), keys, "left_anti").unionByName(frontier), "hub_labels")
    raise RuntimeError(f"labels over nodes of type {kinds['source']} did not settle")


def evaluate(xs: Column, ys: Column, t: Column) -> Column:
    """Arrival at a departure, of breakpoints in columns."""
    k = F.size(F.filter(xs, lambda x: x <= t))
    x0, y0, x1, y1 = F.get(xs, k - 1), F.get(ys, k - 1), F.get(xs, k), F.get(ys, k)
    return F.when(k == 0, t + F.get(ys, F.lit(0)) - F.get(xs, F.lit(0))).when(k == F.size(xs), t + F.element_at(ys, -1) - F.element_at(xs, -1)).otherwise(y0 + (t - x0) / (x1 - x0) * (y1 - y0))


def _common_hubs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (origin, destination, ...) with fx, fy, gx, gy of each hub that both have and that may be best at some departure."""
    outs = labels.where("way = 'out'").select(F.col("node").alias("origin"), "hub", F.col("xs").alias("fx"), F.col("ys").alias("fy"), F.col("low").alias("f_low"), F.col("high").alias("f_high"))
    ins = labels.where("way = 'in'").select(F.col("node").alias("destination"), "hub", F.col("xs").alias("gx"), F.col("ys").alias("gy"), F.col("low").alias("g_low"), F.col("high").alias("g_high"))
    asked = pairs.select("origin", "destination").distinct()
    bounds = asked.join(outs.drop("fx", "fy"), "origin").join(ins.drop("gx", "gy"), ["destination", "hub"])
    best = bounds.groupBy("origin", "destination").agg(F.min(F.col("f_high") + F.col("g_high")).alias("best"))
    able = bounds.join(best, ["origin", "destination"]).where("f_low + g_low <= best").select("origin", "destination", "hub")
    return pairs.join(able, ["origin", "destination"]).join(outs.select("origin", "hub", "fx", "fy"), ["origin", "hub"]).join(ins.select("destination", "hub", "gx", "gy"), ["destination", "hub"])


def hub_arrivals(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, arrival_time of queries (query_id, origin, destination, departure_time); those without a way are absent."""
    rows = _common_hubs(queries.select("query_id", "origin", "destination", F.col("departure_time").cast("double").alias("departure_time")), labels)
    at = rows.withColumn("at_hub", evaluate(F.col("fx"), F.col("fy"), F.col("departure_time")))
    return at.groupBy("query_id").agg(F.min(evaluate(F.col("gx"), F.col("gy"), F.col("at_hub"))).alias("arrival_time"))


def grid_of(edges: DataFrame) -> tuple[float, float, int] | None:
    """Start, interval and size of the grid that all varying functions have."""
    grids = edges.where("ttf.points is not null").select("ttf.start_x", "ttf.interval_x", F.size("ttf.points").alias("n")).distinct().limit(2).collect()
    if len(grids) > 1:
        raise ValueError("the travel-time functions do not have the same start, interval and size")
    return (grids[0].start_x, grids[0].interval_x, grids[0].n) if grids else None


def node_order(edges: DataFrame) -> DataFrame:
    """node_id, order: the nodes from the lowest rank to the highest, numbered from 0."""
    ranked = _ranks(edges).repartitionByRange(F.desc("rank"), "node").sortWithinPartitions(F.desc("rank"), "node").withColumn("at", F.monotonically_increasing_id())
    ranked = cut(ranked.select(F.col("node").alias("node_id"), F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "order")
    sizes = ranked.groupBy("part").count()  # one row for each partition
    first = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("first"))
    return ranked.join(first, "part").select("node_id", (F.col("first") + F.col("place")).alias("order"))


def hub_profiles(pairs: DataFrame, labels: DataFrame, grid: tuple[float, float, int] | None) -> DataFrame:
    """origin, destination, ttf at the points of a grid (start, interval, size; without one, at 0): exact there; pairs without a way are absent."""
    start, step, n = grid or (0.0, 1.0, 1)
    xs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(float(start)) + k * F.lit(float(step)))
    rows = _common_hubs(pairs.select("origin", "destination").distinct(), labels)
    at = rows.select("origin", "destination", "gx", "gy", F.posexplode(F.transform(xs, lambda x: F.struct(x.alias("x"), evaluate(F.col("fx"), F.col("fy"), x).alias("at")))).alias("k", "p"))
    least = at.groupBy("origin", "destination", "k").agg(F.min(evaluate(F.col("gx"), F.col("gy"), F.col("p.at")) - F.col("p.x")).alias("y"))
    listed = least.groupBy("origin", "destination").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "y"))), lambda p: p["y"]).alias("ys"))
    level = F.array_max("ys") - F.array_min("ys") <= 1e-9 * (1 + F.lit(abs(start) + abs(step) * n))
    return listed.select("origin", "destination", F.when(level, pwl.constant(F.get("ys", F.lit(0)))).otherwise(pwl.piecewise(F.lit(float(start)), F.lit(float(step)), F.col("ys"))).cast(pwl.TYPE).alias("ttf"))
