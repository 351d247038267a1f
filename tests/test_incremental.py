"""The two runnable jobs: growing input, replayed batches, late and repeated rows, reruns, command lines."""

import datetime
import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest

from jobs import command, link_loads, observed_conditions

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def growing(tmp_path):
    """A copy of the tables with the events as a folder of three files: two, of which the second is late and repeats rows, and one to come."""
    tables = tmp_path / "tables"
    tables.mkdir()
    shutil.copy(f"{TABLES}/supplier.parquet", tables)
    events = pd.read_parquet(f"{TABLES}/events.parquet")
    (tables / "events.parquet").mkdir()
    parts = [events.iloc[:500], events.iloc[400:700], pd.concat([events.iloc[600:], events.iloc[:50]])]
    for k, part in enumerate(parts[:2]):
        part.to_parquet(tables / f"events.parquet/part-{k}.parquet", coerce_timestamps="us")
    return tables, lambda: parts[2].to_parquet(tables / "events.parquet/part-2.parquet", coerce_timestamps="us")


def rows(frame):
    return sorted((str(r.day), r.edge_id, r.departure_time, round(r.travel_time, 6)) for r in frame.collect())


def test_growing_input_is_taken_once(spark, tmp_path, growing):
    tables, grow = growing
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    first = rows(observed_conditions.run(spark, str(tables), out, mark))
    assert rows(observed_conditions.run(spark, str(tables), out, mark)) == first  # nothing new
    untouched = {d: os.stat(f"{out}/conditions/{d}").st_mtime_ns for d in os.listdir(f"{out}/conditions") if d.startswith("day=")}
    grow()
    second = rows(observed_conditions.run(spark, str(tables), out, mark))
    whole = rows(observed_conditions.run(spark, TABLES, str(tmp_path / "whole"), str(tmp_path / "whole_mark")))
    assert second == whole != first
    batches = sorted(os.listdir(f"{mark}/commits"))
    assert [b for b in batches if not b.startswith(".")] == ["0", "1"]
    events = pd.read_parquet(f"{TABLES}/events.parquet")
    touched = {f"day={d}" for d in pd.concat([events.iloc[600:], events.iloc[:50]]).ts.dt.date}
    assert any(d not in touched for d in untouched), "the new file touches every day"
    assert all(os.stat(f"{out}/conditions/{d}").st_mtime_ns == at for d, at in untouched.items() if d not in touched)


def test_a_batch_that_runs_again_has_the_same_result(spark, tmp_path, growing):
    tables, grow = growing
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    observed_conditions.run(spark, str(tables), out, mark)
    grow()
    once = rows(observed_conditions.run(spark, str(tables), out, mark))
    for name in ("1", ".1.crc"):  # as if the run had been stopped before the batch was committed
        if os.path.exists(f"{mark}/commits/{name}"):
            os.remove(f"{mark}/commits/{name}")
    assert rows(observed_conditions.run(spark, str(tables), out, mark)) == once
    assert os.path.exists(f"{mark}/commits/1")


def test_awkward_events(spark, tmp_path):
    tables = tmp_path / "tables"
    tables.mkdir()
    shutil.copy(f"{TABLES}/supplier.parquet", tables)
    noon = datetime.datetime(2024, 5, 1, 12, 30)
    events = [(1, noon, 0, "e", 10.0, None), (1, noon, 0, "e", 10.0, None), (None, noon, 0, "e", 30.0, None), (None, noon, 0, "e", 30.0, None), (2, None, 0, "e", 5.0, None), (3, noon, None, "e", 5.0, None), (4, noon, 1, "e", None, None)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tables / "events.parquet"))
    got = {r.departure_time: r.travel_time for r in observed_conditions.run(spark, str(tables), str(tmp_path / "o"), str(tmp_path / "c")).collect()}
    free = 500.0 / 8.0
    assert len(got) == 25 and got[0.0] == pytest.approx(free)
    assert got[12 * 3600.0] == got[13 * 3600.0] == pytest.approx(free + 70.0 / 3 * 1.000037)
    none = tmp_path / "none"
    none.mkdir()
    shutil.copy(f"{TABLES}/supplier.parquet", none)
    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(none / "events.parquet"))
    assert observed_conditions.run(spark, str(none), str(tmp_path / "o2"), str(tmp_path / "c2")).count() == 0


def test_loads_are_replaced_by_a_rerun(spark, tmp_path):
    out = str(tmp_path / "out")
    first = sorted(map(tuple, link_loads.run(spark, TABLES, out).collect()))
    assert sorted(map(tuple, link_loads.run(spark, TABLES, out).collect())) == first
    halves = link_loads.run(spark, TABLES, out, period=1800.0)
    assert sum(r.vehicles for r in halves.collect()) == sum(r[1] for r in first)
    free = link_loads.run(spark, TABLES, out, constrain_inflow=False)
    assert sum(r.vehicles for r in free.collect()) == sum(r[1] for r in first)


def test_settings():
    assert command.settings({"interval": 3600.0}, ["--interval", "900", "--tables", "/x"], ("tables",)) == {"interval": 900, "tables": "/x"}
    with pytest.raises(SystemExit):
        command.settings({}, [], ("tables",))


@pytest.mark.parametrize(("job", "table", "more"), [("observed_conditions", "conditions", True), ("link_loads", "loads", False)])
def test_command_line(tmp_path, job, table, more):
    options = ["--tables", TABLES, "--output", str(tmp_path / "out"), *(["--checkpoint", str(tmp_path / "mark")] if more else [])]
    environment = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, f"{REPO}/jobs/{job}.py", *options], capture_output=True, text=True, timeout=300, env=environment, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows" in done.stderr and any("=" in d for d in os.listdir(tmp_path / "out" / table))
