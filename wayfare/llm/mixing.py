"""Mixing sources to target weights, in DataFrame operations only.

Words per source are summed; sources in code point order (null last) weigh 5, 2, 1 in turn and share
``share`` times all words; a target stops at ``most`` times its source's words, and the excess is
reshared by weight.  With sources sorted by cap / weight, the level of the sharing is the greatest
of (total - caps before) / (weights from here on), and a target is the lesser of its cap and weight x level.
A document is emitted floor(rate) times, rate being target / words of its source, and once more
if a number drawn from a hash of seed and doc_id is below the fraction.

A null text has no words; a source without words has rate 0.  Rows without a doc_id, or with one that others have too, would draw alike, and a
source full of them miss its target: these draw with their place in the table as it is read as well, so that the same files give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) rows → source, source_size, target.  One row for each source, so that windows over all of them are small."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    caps = caps.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = caps.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levels.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def copies(drawn_by: Column, rate: Column, seed: int) -> Column:
    """floor(rate), and one more with the fraction's probability."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), drawn_by))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, sizes: DataFrame | None = None, seed: int = 17, **options) -> DataFrame:
    """The rows of ``docs`` (or of ``sizes``: its doc_id, source and mix_size) with mix_size, mix_source_size, mix_target, mix_copies."""
    rows = (docs.withColumn("mix_size", word_count(F.col("text"))) if sizes is None else sizes).withColumn("mix_place", F.monotonically_increasing_id())
    repeated = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("mix_id")).count().where("count > 1").select("mix_id")
    found = targets(rows.select("source", F.col("mix_size").alias("size")), **options)
    found = found.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    # written, so that Spark knows its size before the join and broadcasts it if it is below the threshold: no shuffle by source
    scratch = Scratch(docs.sparkSession, "targets")
    found, repeated = scratch.write(found, "targets"), scratch.write(repeated, "repeated")
    joined = rows.join(found, rows["source"].eqNullSafe(found["mix_source"])).drop("mix_source").join(repeated, F.col("doc_id") == F.col("mix_id"), "left")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    alone = F.col("doc_id").isNotNull() & F.col("mix_id").isNull()
    drawn_by = F.when(alone, F.col("doc_id").cast("string")).otherwise(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mix_place").cast("string")))
    return joined.withColumn("mix_copies", copies(drawn_by, rate, seed)).drop("mix_id", "mix_place")


def mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix: each row of ``docs`` as often as the plan says, with the columns of ``docs`` whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")
    planned = plan(docs.select(whole, "doc_id", "source", "text"), seed=seed, **options)
    repeated = planned.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return repeated.select("mix_row.*")
