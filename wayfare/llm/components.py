"""Connected components by alternating large-star and small-star rounds; of at most ``ONE_TASK`` links, in one task by union-find.

Each round is two aggregations and joins over the remaining links and takes
O(log n) rounds; nothing is collected, and every round is a table in the shared folder.
A hub's links are never gathered in one task: nodes with over a thousandth of all links are
2,000 at most, and their minima are broadcast to wherever their links lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.storage import Scratch


SHARE = 1000
#: Links, 16 bytes each, that one task holds; the components are the same.
ONE_TASK = 1_000_000


def _with_least(links: DataFrame, total: int, own: bool) -> DataFrame:
    """a, b, m: the least neighbour of a (or a itself, where ``own``); ``total`` is the number of links."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if own:
        least = least.withColumn("m", F.least("a", "m"))
    most = max(total // SHARE, 1)
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", "m"))
    others = links.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return links.join(hubs, "a").select("a", "b", "m").unionByName(others.select("a", "b", "m"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, total, True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    known = _with_least(down, total, False)
    others = known.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(known.where("b = m").select("a", "b")).where("a <> b").distinct()


def _union_find(links: DataFrame) -> DataFrame:
    """(node, component) of a few links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches]
        if not parts:
            return
        names, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)]), return_inverse=True)
        a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
        root = np.arange(len(names))
        while True:  # each end points to the lesser root of the two, then every node to its root's root
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while not np.array_equal(root, root[root]):
                root = root[root]
            if np.array_equal(root, before):
                break
        moved = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(links: DataFrame, scratch: Scratch, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``links`` (a, b) → (node, component), component the least node; nodes without links are not listed."""
    now = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen, total = None, now.count()
    if total <= one_task:
        return scratch.write(_union_find(now), "components")
    for _ in range(rounds):
        turned = scratch.write(_large_star(now, total).distinct(), "large")
        new = scratch.write(_small_star(turned, total), "star")
        scratch.drop(turned)
        scratch.drop(now)
        now = new
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen, total = mark, mark[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
