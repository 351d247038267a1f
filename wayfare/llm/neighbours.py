"""Each document beside the next one in descending doc_id order, in one shuffle.

Ranges of doc_id come from approximate quantiles; a range's last document needs
the first of the next range, so that one row of each range is also sent to its
neighbour.  No window over the whole table, nothing collected but the ranges'
bounds (one number for each shuffle partition).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.storage import bound_batches

NULL_ID = -(1 << 63)


def _range_of(bounds: list[int], first: int = 0) -> Column:
    """Number of bounds below the id, by binary search."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(F.col("id") <= bounds[half], _range_of(bounds[:half], first)).otherwise(_range_of(bounds[half + 1 :], first + half + 1))


def with_next(docs: DataFrame, each, schema: str) -> DataFrame:
    """``each(ids, texts, next_texts) -> RecordBatch`` over all rows by descending doc_id.

    After the last document comes the first.  Null ids come last; equal ids are in
    the order of their texts; a null text is empty.  An empty table gives no row.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    bounds = sorted(set(found))[: parts - 1]
    ranged = ids.withColumn("pid", _range_of(bounds))
    firsts = {r.pid: r.id for r in ranged.groupBy("pid").agg(F.max("id").alias("id")).collect()}
    order = sorted(firsts)
    to = {firsts[p]: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    rows = ranged.withColumn("halo", F.lit(False))
    if to:
        target = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
        rows = rows.unionByName(ids.where(F.col("id").isin(list(to))).withColumn("pid", target[F.col("id")]).withColumn("halo", F.lit(True)))
    dealt = rows.repartitionByRange(parts, "pid").sortWithinPartitions("pid", F.desc("halo"), F.desc("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = halo = held = None
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for p, is_halo, doc, text in zip(batch["pid"].to_pylist(), batch["halo"].to_pylist(), batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if p != pid:
                    if held is not None:
                        out.append((*held, halo))
                    pid, halo, held = p, None, None
                if is_halo:
                    halo = text if halo is None else halo
                    continue
                if held is not None:
                    out.append((*held, text))
                held = (doc, text)
                size += len(text)
            if out:
                yield each(*map(list, zip(*out, strict=True)))
        if held is not None:
            yield each([held[0]], [held[1]], [halo])

    return dealt.select("id", "text", "pid", "halo").mapInArrow(run, schema)
