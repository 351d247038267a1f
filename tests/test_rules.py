"""Rules of whole jobs: what is refused, warned of, kept from a day before, and recorded."""

import json
import logging

import pandas as pd
import pytest

from tests.test_jobs import routing, street, table
from wayfare.plans import routing_job, simulation
from wayfare.plans.parameters import simulation_parameters


def changed(path, **files):
    """The parameters with some input files put in, or left out if None."""
    given = json.loads(open(path).read())
    given["input_files"] = {k: v for k, v in (given["input_files"] | files).items() if v is not None}
    with open(path, "w") as file:
        json.dump(given, file)
    return path


@pytest.mark.parametrize("left_out", ["edges", "vehicle_types"])
def test_edges_and_vehicles_come_together(spark, tmp_path, left_out):
    with pytest.raises(ValueError, match="needed together"):
        simulation.load(spark, simulation_parameters(changed(street(tmp_path), **{left_out: None})))


@pytest.mark.parametrize("when", [{"dt_choice.departure_time": 600.0, "dt_choice.type": "Constant"}, {"dt_choice.type": "Discrete", "dt_choice.period": [0.0, 1800.0], "dt_choice.interval": 600.0, "dt_choice.model.type": "Deterministic", "dt_choice.model.u": 0.0}])
def test_a_trip_without_a_way_names_its_ends(spark, tmp_path, when):
    """At a fixed departure by the search, at an open one by the skims."""
    path = street(tmp_path)
    pd.DataFrame({"agent_id": [20]}).to_parquet(tmp_path / "agents.parquet")
    pd.DataFrame([{"agent_id": 20, "alt_id": "back", "class.type": "Road"} | when]).drop(columns="class.type").to_parquet(tmp_path / "alts.parquet")
    pd.DataFrame([{"agent_id": 20, "alt_id": "back", "trip_id": 0, "class.type": "Road", "class.origin": 400, "class.destination": 0, "class.vehicle": "van"}]).to_parquet(tmp_path / "back.parquet")
    path = changed(path, alternatives="alts.parquet", trips="back.parquet")
    with pytest.raises(Exception, match="no route from 400 to 0"):
        simulation.run(spark, path)


def test_edges_without_functions_are_warned_of(spark, tmp_path, caplog):
    """One road has given conditions for the van; the bike, which may not use the lane, has none."""
    pd.DataFrame({"vehicle_id": ["van"] * 2, "edge_id": ["a"] * 2, "departure_time": [0.0, 600.0], "travel_time": [70.0, 80.0]}).to_parquet(tmp_path / "seen.parquet")
    path = changed(street(tmp_path), road_network_conditions="seen.parquet")
    w = simulation.load(spark, simulation_parameters(path))
    with caplog.at_level(logging.WARNING, logger="wayfare"):
        weights = simulation.initial_weights(spark, w, simulation.free_flow(w)).collect()
    said = [r.getMessage() for r in caplog.records if "no function is given" in r.getMessage()]
    assert {(r.uvehicle, r.edge_id) for r in weights if len(r.ttf.points or []) == 2} == {("van", "a")} and len(weights) == 9
    assert [s.rsplit(", they", 1)[0] for s in said] == ["vehicle bike: no function is given for 4 edges (such as a, b, c, d)", "vehicle van: no function is given for 4 edges (such as b, c, d, lane)"]


def test_who_does_not_update_keeps_the_day_before(spark, tmp_path):
    """Nobody updates on the second day: the same alternatives and departures, and no shift between the days."""
    times = simulation.run(spark, street(tmp_path, update_ratio=0.0))
    one = table(spark, tmp_path / "out/iteration_results.parquet").sort_values("iteration_counter")
    assert one["iteration_counter"].tolist() == [1, 2] and one["alt_dep_time_rmse"].iloc[1] == 0
    agents = table(spark, tmp_path / "out/agent_results.parquet").set_index("agent_id")
    assert agents["shifted_alt"].fillna(False).sum() == 0
    recorded = json.loads((tmp_path / "out/running_times.json").read_text())
    stages = {"skims", "demand", "supply", "learning"}
    assert stages <= set(recorded) and stages <= set(recorded["per_iteration"])
    assert all(recorded["per_iteration"][s] == pytest.approx(recorded[s] / 2) for s in stages) and sum(recorded[s] for s in stages) <= recorded["total"] and set(times) <= set(recorded)


def test_routing_records_its_times(spark, tmp_path):
    details = routing_job.run(spark, routing(tmp_path, algorithm="Dijkstra"))
    written = json.loads((tmp_path / "out/details.json").read_text())
    assert written == json.loads(json.dumps(details)) and written["nb_queries"] == 6 and [q for q, _ in written["time_per_query"]] == [11, 12, 13, 14, 15, 16]
