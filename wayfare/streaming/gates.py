"""Gates and observation grids as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _let_through(time: str, held: str | None, order) -> Column:
    """When each arrival could pass a gate that is shut until the times ``held`` of those before it."""
    return F.col(time) if held is None else F.greatest(F.col(time), F.max(held).over(order.rowsBetween(Window.unboundedPreceding, -1)))


def fifo_gate(arrivals: DataFrame, edge: str, time: str, service: Column, chunk: float | None = None, name: str = "exit_time", held: str | None = None, ties: tuple[str, ...] = ("position",)) -> DataFrame:
    """``exit_time`` of each arrival at a gate that serves in order, each one closing it for ``service`` seconds.

    The k-th leaves at S(k-1) + max over j <= k of (arrival j - S(j-1)), S the running sum of services.  Ties are in the order of ``ties``.
    With ``chunk``, an edge's arrivals are summed up by stretches of so many seconds first, and each stretch starts from what those before it
    come to: an edge that sees a third of all arrivals is the work of many tasks.  ``held``, a column of times, keeps the gate shut behind
    an arrival until then (null: no longer than its service).
    """
    if chunk is None:
        order = Window.partitionBy(edge).orderBy(time, *ties)
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        served = arrivals.withColumn("gate_s", F.sum(service).over(upto) - service)
        served = served.withColumn("gate_a", _let_through(time, held, order))
        peak = F.max(F.col("gate_a") - F.col("gate_s")).over(upto)
        return served.withColumn(name, F.col("gate_s") + peak).drop("gate_s", "gate_a")
    order = Window.partitionBy(edge, "gate_c").orderBy(time, *ties)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = arrivals.withColumn("gate_c", F.floor(F.col(time) / chunk)).withColumn("gate_v", service)
    local = rows.withColumn("gate_s", F.sum("gate_v").over(upto) - F.col("gate_v"))
    local = local.withColumn("gate_a", _let_through(time, held, order)).withColumn("gate_p", F.max(F.col("gate_a") - F.col("gate_s")).over(upto))
    whole = local.groupBy(F.col(edge).alias("gate_e"), F.col("gate_c").alias("gate_k")).agg(F.sum("gate_v").alias("total"), F.max("gate_p").alias("peak"), F.max(F.lit(None).cast("double") if held is None else F.col(held)).alias("until"))
    earlier = Window.partitionBy("gate_e").orderBy("gate_k").rowsBetween(Window.unboundedPreceding, -1)
    summed = whole.withColumn("gate_b", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    # a gate held by an earlier stretch is shut for the first arrival of this one
    summed = summed.withColumn("gate_h", F.max("until").over(earlier) - F.col("gate_b"))
    summed = summed.withColumn("gate_m", F.greatest(F.max(F.col("peak") - F.col("gate_b")).over(earlier), F.max("gate_h").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))).select("gate_e", "gate_k", "gate_b", "gate_m")
    joined = local.join(summed, (F.col(edge) == F.col("gate_e")) & (F.col("gate_c") == F.col("gate_k")))
    leaves = F.col("gate_b") + F.col("gate_s") + F.greatest(F.col("gate_p") - F.col("gate_b"), F.col("gate_m"))
    return joined.withColumn(name, leaves).drop("gate_c", "gate_v", "gate_s", "gate_a", "gate_p", "gate_e", "gate_k", "gate_b", "gate_m")


def fifo_gate_varying(arrivals: DataFrame, edge: str, time: str, times: str, closings: str, stages: int, name: str = "exit_time", held: str | None = None, ties: tuple[str, ...] = ("position",)) -> DataFrame:
    """The same at a gate whose closing depends on when a vehicle passes: the j-th of ``closings`` from the j-th of ``times`` on (before the first, that too).

    Within a stretch of constant closings the exits are those of ``fifo_gate``, from when the gate opens behind the last one of the stretch before; those that
    would fall behind its end are left to the next stretch.  ``stages`` is the number of times that an edge has at most; all stages read one sorted partition.
    ``held`` and ``ties`` are those of ``fifo_gate``.
    """
    order = Window.partitionBy(edge).orderBy(time, *ties)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None).cast("double")
    rows = arrivals.withColumn("gate_f", _let_through(time, held, order)).withColumn("gate_e", none).withColumn("gate_o", none)
    for j in range(stages):
        waiting, end = F.col("gate_e").isNull(), F.get(times, F.lit(j + 1))
        rows = rows.withColumn("gate_c", F.get(closings, F.lit(j)))
        rows = rows.withColumn("gate_s", F.sum(F.when(waiting, F.col("gate_c"))).over(upto) - F.col("gate_c")).withColumn("gate_a", F.greatest(F.col("gate_f"), F.last("gate_o", ignorenulls=True).over(upto)))
        rows = rows.withColumn("gate_x", F.col("gate_s") + F.max(F.when(waiting, F.col("gate_a") - F.col("gate_s"))).over(upto))
        passes = waiting & (end.isNull() | (F.col("gate_x") < end))
        rows = rows.withColumn("gate_o", F.when(passes, F.col("gate_x") + F.col("gate_c")).otherwise(F.col("gate_o"))).withColumn("gate_e", F.when(passes, F.col("gate_x")).otherwise(F.col("gate_e")))
    return rows.withColumn(name, F.col("gate_e")).drop("gate_c", "gate_s", "gate_a", "gate_f", "gate_x", "gate_e", "gate_o")


def occupied_at_entry(rows: DataFrame, edge: str, entry: str, freed: str, headway: str, name: str = "occupied", ties: tuple[str, ...] = ("position",)) -> DataFrame:
    """Length of the vehicles that are on the edge when each one enters it: a running sum of what entered before less what was freed by then, at one time first what is freed."""
    both = F.explode(F.array(F.struct(F.lit(1).alias("enters"), F.col(entry).alias("at"), F.col(headway).alias("more")), F.struct(F.lit(0).alias("enters"), F.col(freed).alias("at"), (-F.col(headway)).alias("more")))).alias("occ")
    order = Window.partitionBy(edge).orderBy("occ.at", "occ.enters", *ties).rowsBetween(Window.unboundedPreceding, -1)
    events = rows.select("*", both).withColumn(name, F.greatest(F.coalesce(F.sum("occ.more").over(order), F.lit(0.0)), F.lit(0.0)))
    return events.where("occ.enters = 1").drop("occ")


def observe(records: DataFrame, keys: list[str], time: str, value: str, start: float, end: float, interval: float) -> DataFrame:
    """keys, bin, x, y: each record counts for the two grid points beside it by nearness; y is the weighted mean, 0 without records.

    Records after the end are late and are dropped.
    """
    n = int((end - start) / interval + 1e-9) + 1
    on_time = records.where((F.col(time) >= start) & (F.col(time) <= end))
    place = (F.col(time) - start) / interval
    low = F.floor(place).cast("int")
    share = place - low
    split = F.explode(F.array(F.struct(low.alias("bin"), (1 - share).alias("w")), F.struct((low + 1).alias("bin"), share.alias("w")))).alias("s")
    split_rows = on_time.select(*keys, F.col(value).alias("grid_y"), split).where((F.col("s.w") > 0) & (F.col("s.bin") < n))
    means = split_rows.groupBy(*keys, F.col("s.bin").alias("bin")).agg((F.sum(F.col("grid_y") * F.col("s.w")) / F.sum("s.w")).alias("y"))
    grid = records.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return grid.join(means, [*keys, "bin"], "left").select(*keys, "bin", (F.lit(float(start)) + F.col("bin") * float(interval)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def simulated_weights(entry: Column, road: Column, exit_: Column, margin: float = 1e-8) -> Column:
    """Travel-time function of an edge: wait to enter, travel, wait to leave, each link kept first-in first-out."""
    from wayfare.functions import pwl

    def fifo(f: Column) -> Column:
        return pwl.bind(f, lambda x: pwl.ensure_fifo(x, margin))

    entered = fifo(pwl.bind(fifo(road), lambda r: pwl.link(entry, r)))
    return fifo(pwl.bind(entered, lambda f: pwl.link(f, exit_)))


def road_function(lengths: Column, travel_time, bound: float = 0.0) -> Column:
    """Travel time at the observed lengths; constant at its first value if its range is ``bound`` or less."""
    from wayfare.functions import pwl

    def settled(f: Column) -> Column:
        first = F.coalesce(F.element_at(f["points"], 1), f["cst"])
        return F.when(pwl.practically_constant(f, F.lit(bound)), pwl.constant(first)).otherwise(f)

    return pwl.bind(pwl.apply_values(lengths, travel_time), settled)
