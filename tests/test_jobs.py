"""Whole jobs from files to files."""

import json

import numpy as np
import pandas as pd
import pytest

from wayfare.plans import routing_job, simulation
from wayfare.plans.parameters import simulation_parameters
from wayfare.sources import sinks


def write(folder, **tables):
    for name, rows in tables.items():
        pd.DataFrame(rows).convert_dtypes().to_parquet(folder / f"{name}.parquet")
    return {name: f"{name}.parquet" for name in tables}


def table(spark, path):
    return spark.read.parquet(str(path)).toPandas()


def street(folder, **more):
    """A street of four blocks, 500 m each at 10 m/s, with a slow lane behind its middle blocks; people who walk, ride and drive along it.

    Every person is here for one of the checks below: 10 has no trip, 20 drives where and when fixed, 30 makes a stop on the way,
    40 picks between bus and car, 50 leaves at any time, 60 keeps to a given way.
    """
    people, plans, steps = [], [], []

    def person(key, kind=None, u=None, mu=None):
        people.append({"agent_id": key, "alt_choice.type": kind, "alt_choice.u": u, "alt_choice.mu": mu})

    def plan(key, name, leave=None, trips=(), **columns):
        fixed = {"dt_choice.type": "Constant", "dt_choice.departure_time": leave} if leave is not None else {}
        plans.append({"agent_id": key, "alt_id": name} | fixed | columns)
        steps.extend({"agent_id": key, "alt_id": name, "trip_id": k} | t for k, t in enumerate(trips))

    def drive(start, end, by, **columns):
        return {"class.type": "Road", "class.origin": start, "class.destination": end, "class.vehicle": by} | columns

    person(10)
    plan(10, "home", constant_utility=1.5)
    person(20)
    plan(20, "work", 600.0, [drive(0, 400, "van")])
    person(30, "Logit", 0.4, 2.0)
    plan(30, "errand", None, [drive(0, 200, "van", stopping_time=120.0), drive(200, 400, "bike", **{"schedule_utility.type": "Linear", "schedule_utility.tstar": 2000.0, "schedule_utility.gamma": 0.01})],
         **{"dt_choice.type": "Discrete", "dt_choice.period": [900.0, 2100.0], "dt_choice.interval": 400.0, "dt_choice.offset": 25.0, "dt_choice.model.type": "Deterministic", "dt_choice.model.u": 0.5, "dt_choice.model.constants": [0.0, 4.0, 1.0]})
    person(40, "Deterministic", 0.0)
    plan(40, "bus", 1000.0, [{"class.type": "Virtual", "class.travel_time": 900.0}], constant_utility=2.0, alpha=0.001)
    plan(40, "car", 1000.0, [drive(0, 400, "van")], constant_utility=-50.0)
    person(50)
    plan(50, "any", None, [drive(100, 400, "van")], alpha=0.002, origin_delay=15.0, **{"dt_choice.type": "Continuous", "dt_choice.model.type": "Logit", "dt_choice.model.u": 0.25, "dt_choice.model.mu": 1.0})
    person(60)
    plan(60, "slow", 300.0, [drive(0, 400, "van", **{"class.route": ["a", "lane", "d"]})], pre_compute_route=True)

    def block(key, start, end, length=500.0, speed=10.0, **columns):
        return {"edge_id": key, "source": start, "target": end, "length": length, "speed": speed} | columns

    roads = [block("a", 0, 100), block("b", 100, 200, bottleneck_flow=0.2), block("c", 200, 300, lanes=2.0), block("d", 300, 400, **{"constant_travel_time": 5.0})]
    roads.append(block("lane", 100, 300, 900.0, 3.0, **{"speed_density.type": "Bottleneck", "speed_density.capacity": 1.0}))
    types = [{"vehicle_id": "van", "headway": 6.0, "pce": 1.0}, {"vehicle_id": "bike", "headway": 1.0, "pce": 0.2, "speed_function.type": "Multiplicator", "speed_function.coef": 0.5, "restricted_edges": ["lane"]}]
    names = ("agents", "alternatives", "trips", "edges", "vehicle_types")
    files = write(folder, **{n: pd.DataFrame(rows).to_dict("list") for n, rows in zip(names, (people, plans, steps, roads, types), strict=True)})
    parameters = {
        "input_files": files, "output_directory": "out", "period": [0, 3600], "departure_time_interval": 120.0, "random_seed": 3, "max_iterations": 2, "learning_model": {"type": "Linear"},
        "road_network": {"recording_interval": 600, "approximation_bound": 0.5, "spillback": True, "backward_wave_speed": 5.0, "max_pending_duration": 60.0},
    } | more
    (folder / "parameters.json").write_text(json.dumps(parameters))
    return str(folder / "parameters.json")


def test_simulation_writes_all_tables(spark, tmp_path):
    simulation.run(spark, street(tmp_path))
    agents = table(spark, tmp_path / "out/agent_results.parquet").set_index("agent_id")
    assert list(agents.columns) == simulation.AGENT_COLUMNS[1:] and sorted(agents.index) == [10, 20, 30, 40, 50, 60]
    assert agents.loc[10, "selected_alt_id"] == "home" and agents.loc[10, "utility"] == 1.5 and np.isnan(agents.loc[10, "departure_time"])
    assert agents.loc[40, "selected_alt_id"] == "bus" and agents.loc[40, "nb_virtual_trips"] == 1 and agents.loc[40, "arrival_time"] == 1900 and agents.loc[40, "utility"] == pytest.approx(2 - 0.9)
    assert agents.loc[20, "arrival_time"] == pytest.approx(600 + 4 * 50 + 5)  # nobody else is near: blocks at 10 m/s and the wait at the end
    assert agents.loc[30, "departure_time"] == 900 + 200 + 400 + 25 and agents.loc[30, "nb_road_trips"] == 2  # the second slot has the greatest constant
    assert 0 <= agents.loc[50, "departure_time"] <= 3600
    trips = table(spark, tmp_path / "out/trip_results.parquet")
    stops = trips[trips.agent_id == 30].sort_values("trip_index")
    assert stops["route_free_flow_travel_time"].tolist() == pytest.approx([100, 100 + 105]) and stops["length"].tolist() == [1000, 1000]  # half as fast by bike
    assert stops["departure_time"].iloc[1] == pytest.approx(stops["arrival_time"].iloc[0] + 120)
    assert stops["schedule_utility"].iloc[1] == pytest.approx(-0.01 * max(stops["arrival_time"].iloc[1] - 2000, 0))
    given = trips[trips.agent_id == 60].iloc[0]
    assert given["route_free_flow_travel_time"] == given["global_free_flow_travel_time"] == pytest.approx(50 + 300 + 55)
    routes = table(spark, tmp_path / "out/route_results.parquet")
    for key, way in ((60, ["a", "lane", "d"]), (20, ["a", "b", "c", "d"])):
        taken = routes[routes.agent_id == key].sort_values("entry_time")
        assert taken["edge_id"].tolist() == way and (taken["exit_time"] > taken["entry_time"]).all()
    iterations = table(spark, tmp_path / "out/iteration_results.parquet").sort_values("iteration_counter")
    assert iterations["iteration_counter"].tolist() == [1, 2] and list(iterations.columns) == simulation.ITERATION_COLUMNS
    assert iterations["road_trip_count"].tolist() == [5, 5] and iterations["virtual_trip_count"].tolist() == [1, 1] and iterations["no_trip_alt_count"].tolist() == [1, 1]
    assert iterations["alt_dep_time_rmse"].iloc[1] >= 0 and "Iterations" in (tmp_path / "out/report.html").read_text()
    skims = sinks.read_json_file(spark, str(tmp_path / "out/skim_results.json.zst"))
    assert {(s["origin"], s["destination"]) for own in skims.values() for s in own} >= {(0, 200), (100, 400)}
    sampled = table(spark, tmp_path / "out/net_cond_exp_edge_ttfs.parquet")
    assert len(sampled) == 7 * (5 + 4)  # points of the period by edges open to the van and the bike
    assert json.loads((tmp_path / "out/running_times.json").read_text())["total"] > 0


def test_decisions_only(spark, tmp_path):
    simulation.run(spark, street(tmp_path, only_compute_decisions=True))
    agents = table(spark, tmp_path / "out/agent_results.parquet")
    assert sorted(agents["agent_id"]) == [10, 20, 30, 40, 50, 60] and len(agents.columns) == 7
    routes = table(spark, tmp_path / "out/route_results.parquet")
    own = routes[routes.agent_id == 30].sort_values("entry_time")
    assert own["edge_id"].tolist() == ["a", "b", "c", "d"] and own["exit_time"].iloc[0] == pytest.approx(own["entry_time"].iloc[0] + 50)


def test_agents_without_alternatives_fail(spark, tmp_path):
    path = street(tmp_path)
    pd.DataFrame({"agent_id": [10, 99]}).to_parquet(tmp_path / "agents.parquet")
    with pytest.raises(ValueError, match="without alternatives"):
        simulation.load(spark, simulation_parameters(path))


def routing(folder, **more):
    """A triangle and a way out: 7 to 9 direct (slow around 600) or over 8; from 5 nobody comes back."""
    files = write(
        folder,
        edges={"edge_id": [70, 71, 72, 73], "source": [7, 8, 7, 9], "target": [8, 9, 9, 5], "travel_time": [30.0, 40.0, 60.0, 12.0]},
        queries={"query_id": [11, 12, 13, 14, 15, 16], "origin": [7, 7, 7, 5, 5, 8], "destination": [9, 5, 9, 7, 8, 8], "departure_time": [0.0, 600.0, None, 0.0, None, 3.0]},
        edge_ttfs={"edge_id": [72] * 3, "departure_time": [0.0, 600.0, 1200.0], "travel_time": [60.0, 90.0, 60.0]},
    )
    (folder / "parameters.json").write_text(json.dumps({"input_files": files, "output_directory": "out", "output_route": True} | more))
    return str(folder / "parameters.json")


@pytest.mark.parametrize("algorithm", ["Best", "Intersect", "TCH", "Dijkstra"])
def test_routing_job(spark, tmp_path, algorithm):
    details = routing_job.run(spark, routing(tmp_path, algorithm=algorithm, output_order=True, output_overlay=algorithm == "Intersect"))
    assert details["nb_queries"] == 6 and len(details["time_per_query"]) == 6
    ea = table(spark, tmp_path / "out/ea_results.parquet").set_index("query_id")
    assert ea.loc[11, "arrival_time"] == 60 and ea.loc[12, "arrival_time"] == 600 + 70 + 12 and np.isnan(ea.loc[14, "arrival_time"]) and ea.loc[16, "arrival_time"] == 3
    if algorithm != "Intersect":  # which gives no routes
        assert list(ea.loc[11, "route"]) == [72] and list(ea.loc[12, "route"]) == [70, 71, 73] and list(ea.loc[16, "route"]) == [] and ea.loc[14, "route"] is None
    profile = table(spark, tmp_path / "out/profile_results.parquet").sort_values(["query_id", "departure_time"])
    assert profile[profile.query_id == 13]["travel_time"].tolist() == [60, 70, 60]
    assert profile[profile.query_id == 15][["departure_time", "travel_time"]].isna().all().all()
    order = table(spark, tmp_path / "out/node_order.parquet")
    assert sorted(order["node_id"]) == [5, 7, 8, 9]
    if algorithm != "Intersect":
        return
    overlay = json.loads((tmp_path / "out/overlay.json").read_text())
    rank = dict(overlay["order"])
    assert all(rank[e["source"]] < rank[e["target"]] for e in overlay["upward"]) and all(rank[e["source"]] > rank[e["target"]] for e in overlay["downward"])


def test_restricted_roads(spark, tmp_path):
    """Two ways from 1 to 6, a short tunnel and a long pass; lorries may not use the tunnel by any of the three kinds of lists."""
    kinds = {"car": {}, "banned": {"restricted_edges": ["tunnel"]}, "listed": {"allowed_edges": ["in", "pass", "out"]}, "both": {"allowed_edges": ["in", "tunnel", "out"], "restricted_edges": ["tunnel"]}}
    ways = [("in", 1, 2, 20.0), ("tunnel", 2, 5, 40.0), ("pass", 2, 5, 70.0)]
    ways = [w if w[0] != "pass" else ("pass", 2, 4, 70.0) for w in ways] + [("down", 4, 5, 10.0), ("out", 5, 6, 30.0)]
    kinds["listed"]["allowed_edges"].append("down")
    drivers = list(kinds)
    files = write(
        tmp_path,
        agents={"agent_id": drivers},
        alternatives={"agent_id": drivers, "alt_id": ["go"] * 4, "dt_choice.type": ["Constant"] * 4, "dt_choice.departure_time": [100.0 * k for k in range(4)]},
        trips={"agent_id": drivers, "alt_id": ["go"] * 4, "trip_id": ["t"] * 4, "class.type": ["Road"] * 4, "class.origin": [1] * 4, "class.destination": [6] * 4, "class.vehicle": drivers},
        edges={"edge_id": [w[0] for w in ways], "source": [w[1] for w in ways], "target": [w[2] for w in ways], "length": [w[3] for w in ways], "speed": [2.0] * 5},
        vehicle_types={"vehicle_id": drivers, "headway": [4.0] * 4, "allowed_edges": [kinds[k].get("allowed_edges") for k in drivers], "restricted_edges": [kinds[k].get("restricted_edges") for k in drivers]},
    )
    (tmp_path / "parameters.json").write_text(json.dumps({"input_files": files, "output_directory": "out", "period": [0, 900], "road_network": {"recording_interval": 90, "spillback": False}}))
    simulation.run(spark, str(tmp_path / "parameters.json"))
    agents = table(spark, tmp_path / "out/agent_results.parquet").set_index("agent_id")["arrival_time"].to_dict()
    assert agents == {"car": 45, "banned": 100 + 65, "listed": 200 + 65, "both": 300 + 45}  # a list of allowed roads wins over one of banned ones
    row = table(spark, tmp_path / "out/iteration_results.parquet").iloc[0]
    assert row["road_trip_count"] == row["nb_agents_all_road_trips"] == 4 and row["virtual_trip_count"] == 0


def test_routing_job_on_csv(spark, tmp_path):
    path = routing(tmp_path, saving_format="CSV", algorithm="Dijkstra")
    parameters = json.loads((tmp_path / "parameters.json").read_text())
    for name in list(parameters["input_files"]):
        pd.read_parquet(tmp_path / f"{name}.parquet").to_csv(tmp_path / f"{name}.csv", index=False)
        parameters["input_files"][name] = f"{name}.csv"
    (tmp_path / "parameters.json").write_text(json.dumps(parameters))
    routing_job.run(spark, path)
    got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out/ea_results.csv")).toPandas().set_index("query_id")
    assert got.loc[12, "arrival_time"] == 682 and got.loc[12, "route"] == "70,71,73"


def test_table_rules(spark, tmp_path):
    from wayfare.sources import tables

    nested = spark.sql("select 1 as edge_id, 1 as source, 2 as target, 5.0 as speed, 10 as length, named_struct('type', 'Bottleneck', 'capacity', 2.0, 'other', 1) as speed_density, 3 as surplus")
    row = tables.read(nested, "edges").first()
    assert row.speed_density_capacity == 2 and row.lanes == 1 and row.overtaking is True and row.length == 10.0
    assert tables.unused(nested, tables.TABLES["edges"][0]) == ["speed_density.other", "surplus"]
    with pytest.raises(Exception, match="speed must be positive"):
        tables.read(nested.selectExpr("* except (speed)", "-1.0 as speed"), "edges").collect()
    with pytest.raises(ValueError, match="missing"):
        tables.read(nested.drop("source"), "edges")
    with pytest.raises(ValueError, match="duplicate"):
        tables.require_unique(tables.read(nested.union(nested), "edges"), "edges")
    with pytest.raises(ValueError, match="parquet and .csv"):
        tables.scan(spark, "a.xlsx")
    listed = spark.sql("select 1 as vehicle_id, 1.0 as headway, array(1, null) as allowed_edges")
    assert tables.read(listed, "vehicle_types").first().allowed_edges is None
    (tmp_path / "x.json.zst").write_bytes(__import__("zstandard").ZstdCompressor().compress(b'{"a": [1, null]}'))
    assert tables.read_json(str(tmp_path / "x.json.zst")) == {"a": [1, None]}


def test_sinks(spark, tmp_path):
    from wayfare.sources import sinks

    assert sinks.write_table(spark.range(0), str(tmp_path), "none") is None and not (tmp_path / "none.parquet").exists()
    for fmt in ("Parquet", "CSV", "JSON"):
        sinks.write_table(spark.range(3), str(tmp_path), "rows", fmt)
        sinks.append_rows(spark.range(2), str(tmp_path), "rows", fmt)
        reader = spark.read.option("header", True) if fmt == "CSV" else spark.read
        assert reader.format(fmt.lower()).load(str(tmp_path / f"rows.{fmt.lower()}")).count() == 5
    for k in range(2):
        sinks.append_json({"k": k}, f"file://{tmp_path}/new/list.json")
        sinks.append_json({"k": k}, str(tmp_path / "list.json"))
    assert (tmp_path / "new/list.json").read_text() == (tmp_path / "list.json").read_text()
    assert json.loads((tmp_path / "list.json").read_text()) == [{"k": 0}, {"k": 1}]


def test_command_line(spark, tmp_path):
    from wayfare import cli

    assert cli.main(["route", routing(tmp_path)]) == 0 and (tmp_path / "out/details.json").exists() and (tmp_path / "out/log.txt").exists()
    assert cli.main(["route", str(tmp_path / "nothing.json")]) == 1
    uri = f"file://{tmp_path}/store"  # an output folder named by a URI
    assert cli.main(["route", routing(tmp_path, output_directory=uri, output_overlay=True)]) == 0
    assert {"details.json", "log.txt", "overlay.json", "ea_results.parquet"} <= {f.name for f in (tmp_path / "store").iterdir()}


def test_rules_of_choice_models(spark):
    from wayfare.sources import tables

    def read(**columns):
        row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"`{k}` {'double' if isinstance(v, float | None) else 'string'}" for k, v in columns.items()))
        return tables.read(row, "alternatives").collect()

    base = {"agent_id": "1", "alt_id": "1", "dt_choice.type": "Continuous"}
    for missing in ({"dt_choice.model.type": "Logit", "dt_choice.model.u": None, "dt_choice.model.mu": 1.0}, {"dt_choice.model.type": "Logit", "dt_choice.model.u": 0.5, "dt_choice.model.mu": None}):
        with pytest.raises(Exception, match="needs u and mu"):
            read(**base, **missing)
    with pytest.raises(Exception, match="needs a Logit model"):
        read(**base)
    assert read(**base, **{"dt_choice.model.type": "Logit", "dt_choice.model.u": 0.5, "dt_choice.model.mu": 1.0})


@pytest.mark.parametrize("kind", ["Intersect", "TCH", "Dijkstra"])
def test_strategies_of_the_simulation_agree(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr("wayfare.operators.network.POPULAR", 1)
    path = street(tmp_path, max_iterations=1, road_network={"recording_interval": 600, "spillback": False, "algorithm_type": kind})
    simulation.run(spark, path)
    agents = table(spark, tmp_path / "out/agent_results.parquet").set_index("agent_id")
    assert agents.loc[30, "departure_time"] == 1525 and agents.loc[20, "arrival_time"] == pytest.approx(805)
    assert agents.loc[50, "departure_time"] == pytest.approx(900.0, abs=1.0)  # a flat utility: a fourth of the period


@pytest.mark.parametrize(("constrain_inflow", "overtaking"), [(True, True), (False, True), (True, False)])
def test_queues_alone_give_the_times_of_the_events(spark, tmp_path, monkeypatch, constrain_inflow, overtaking):
    """One day without spillback with eight drivers at the gates within a few minutes, relationally and by events: the same tables."""
    found = []
    for kind, relational in (("queues", True), ("events", False)):
        folder = tmp_path / kind
        folder.mkdir()
        monkeypatch.setattr(simulation, "MOST_LEGS", 0 if relational else 5_000_000)  # beyond it exits without overtaking are queues, too
        if not relational:
            monkeypatch.setattr(simulation, "_only_queues", lambda w, legs: False)
        path = street(folder, max_iterations=1, road_network={"recording_interval": 600, "spillback": False, "constrain_inflow": constrain_inflow})
        edges = pd.read_parquet(folder / "edges.parquet")
        if not overtaking:
            edges = edges.assign(bottleneck_flow=[0.0113, 0.00507, None, 0.0203, 0.00101], overtaking=False)
        elif constrain_inflow:  # a lane whose speed falls when it is full, and a gate that changes with time
            edges = edges.assign(bottleneck_flow=[None, 0.00507, None, 0.0203, 0.00101], bottleneck_times=[[0.0, 700.0], None, None, None, None], bottleneck_flows=[[0.0113, 0.00409], None, None, None, None])
        else:
            edges = edges.drop(columns=[c for c in edges if c.startswith("speed_density")]).assign(bottleneck_flow=[0.00407, 0.00507, None, 0.0203, 0.00101])
        edges.to_parquet(folder / "edges.parquet")
        for name in ("agents", "alternatives", "trips"):  # seven more like 20, who leave soon after one another
            rows = pd.read_parquet(folder / f"{name}.parquet")
            like = [rows[rows.agent_id == 20].assign(agent_id=200 + k) for k in range(7)] + ([rows[rows.agent_id == 60].assign(agent_id=300)] if constrain_inflow else [])
            if name == "alternatives":
                like = [r.assign(**{"dt_choice.departure_time": 540.0 + 37.3 * k}) for k, r in enumerate(like[:7])] + [r.assign(**{"dt_choice.departure_time": 311.7}) for r in like[7:]]
            pd.concat([rows, *like]).to_parquet(folder / f"{name}.parquet")
        simulation.run(spark, path)
        tables = {n: table(spark, folder / f"out/{n}.parquet") for n in ("agent_results", "trip_results", "route_results", "iteration_results", "net_cond_sim_edge_ttfs")}
        found.append({n: t.sort_values(list(t.columns[:4])).reset_index(drop=True) for n, t in tables.items()})
    for name, one in found[0].items():
        pd.testing.assert_frame_equal(one, found[1][name], check_dtype=False, atol=1e-6)
    trips = found[0]["trip_results"]
    waited = trips["in_bottleneck_time"] if constrain_inflow else trips["out_bottleneck_time"]
    if not overtaking:  # those behind the one at an entry wait on the road before it
        waited = trips["in_bottleneck_time"] + trips["out_bottleneck_time"]
    assert waited.max() > 1000 and (waited > 10).sum() >= 7
