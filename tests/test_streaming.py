"""The streaming grid gives what the batch operator gives."""

import datetime

from pyspark.sql import functions as F

from wayfare.streaming import gates, observations

START = datetime.datetime(2024, 1, 1)
SCHEMA = "edge_id int, ts timestamp, y double"


def _observed(spark, folder, name, batches):
    """Rows that the stream emits of files that come one after another."""
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in batches]
    (folder / "in").mkdir()
    stream = spark.readStream.schema(frames[0].schema).parquet(str(folder / "in"))
    running = observations.observe_stream(stream, ["edge_id"], "ts", "y", "10 minutes", "1 minute").writeStream.format("memory").queryName(name).outputMode("append").start()
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        running.processAllAvailable()
    running.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def _batch(spark, rows):
    seconds = spark.createDataFrame(rows, SCHEMA).withColumn("t", (F.unix_micros("ts") - F.unix_micros(F.lit(START))) / 1e6)
    return {(r.edge_id, START + datetime.timedelta(seconds=r.x)): r.y for r in gates.observe(seconds, ["edge_id"], "t", "y", 0.0, 9000.0, 600.0).collect()}


def _at(edge, seconds, y):
    return edge, START + datetime.timedelta(seconds=seconds), y


def test_stream_equals_batch(spark, tmp_path):
    rows = [_at(k % 3, 37 * k, float(k % 11)) for k in range(200)]
    got = _observed(spark, tmp_path, "observed", [[*rows, _at(0, 172800, 0.0), (1, None, 5.0), _at(2, 50, None)]])
    found, want = {(e, p): y for e, p, y in got}, _batch(spark, rows)
    assert len(got) == len(found)  # each point once
    assert all(abs(want[k] - y) < 1e-9 for k, y in found.items() if k in want)
    assert len([k for k in found if k in want]) == 3 * 14


def test_each_point_is_emitted_once_over_batches(spark, tmp_path):
    """Records in three files; of those that come too late one is dropped, one counts for its later point alone."""
    first = [_at(k % 2, 50.5 * k, float(k % 7)) for k in range(60)]  # to 2979.5 s: points up to 1800 are done, 2400 is open
    second = [_at(0, 700, 1000.0), _at(1, 2000, 9.0), _at(1, 3300, 4.0), _at(0, 5000, 1.0)]
    third = [_at(0, 5100, 3.0), _at(0, 200000, 0.0)]
    got = _observed(spark, tmp_path, "observed_late", [first, second, third])
    found = {(e, p): y for e, p, y in got}
    assert len(got) == len(found)
    early = START + datetime.timedelta(seconds=1800)
    on_time = _batch(spark, [*first, *second[1:], *third[:1]])
    without = _batch(spark, [*first, *second[2:], *third[:1]])
    for (edge, point), y in found.items():
        assert abs(y - (without if point <= early else on_time)[edge, point]) < 1e-9
    assert abs(on_time[1, START + datetime.timedelta(seconds=2400)] - without[1, START + datetime.timedelta(seconds=2400)]) > 1e-3
    assert {p for e, p in found if e == 1} >= {START + datetime.timedelta(seconds=600 * k) for k in range(1, 6)}


def test_a_table_that_does_not_stream(spark):
    rows = [_at(k % 3, 37 * k, float(k % 11)) for k in range(200)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("total", F.lit("clash"))
    got = {(r.edge_id, r.point): r.y for r in observations.observe_stream(table, ["edge_id"], "ts", "y", "10 minutes", "1 minute").collect()}
    want = _batch(spark, rows)
    assert got and all(abs(want[k] - y) < 1e-9 for k, y in got.items() if k in want)
    assert observations.observe_stream(table.limit(0), ["edge_id"], "ts", "y", "10 minutes", "1 minute").isEmpty()
