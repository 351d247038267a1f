"""What a round of the queues writes: times that it moved, and nothing that follows from the other columns."""

from wayfare.plans import within_day


def test_rounds_write_few_columns(spark, monkeypatch):
    rows = spark.createDataFrame([(t, k, e, 1.0 * t, 0.0, 5.0, 20.0, True) for t in range(6) for k, e in enumerate((t % 2, 2))], "trip_id long, position long, edge_id long, departure double, gap double, spent double, closing double, ordered boolean")
    tables, own = [], within_day.cut
    monkeypatch.setattr(within_day, "cut", lambda df, label: tables.append(own(df, label)) or tables[-1])
    monkeypatch.setattr(within_day, "drop", lambda table: None)
    got = within_day.queue_steps(rows)
    assert {"trip_id", "position", "reach_time", "entry_time", "at_exit", "exit_time"} <= set(got.columns)
    assert [r.at_exit - r.entry_time for r in got.collect()] == [5.0] * 12
    assert all({"position", "at_exit", "held_until"}.isdisjoint(t.columns) for t in tables[1:])
    assert tables[-1].where("next_reach is not null").isEmpty() and not tables[1].where("next_reach is not null").isEmpty()
