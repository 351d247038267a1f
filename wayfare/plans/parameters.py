"""Parameters of a simulation and of a routing job, passed explicitly."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from wayfare.sources.tables import read_json


def _known(kind, values: dict):
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in values.items() if k in names})


@dataclass(frozen=True)
class Contraction:
    edge_quotient_weight: float = 2.0
    hierarchy_depth_weight: float = 1.0
    unpacked_edges_quotient_weight: float = 1.0
    complexity_quotient_weight: float = 2.0
    thin_profile_interval_hop_limit: int = 16


@dataclass(frozen=True)
class RoadNetwork:
    recording_interval: float
    approximation_bound: float = 0.0
    spillback: bool = True
    backward_wave_speed: float | None = None
    max_pending_duration: float = 0.0
    constrain_inflow: bool = True
    algorithm_type: str = "Best"
    contraction: Contraction = field(default_factory=Contraction)

    def __post_init__(self) -> None:
        if self.spillback and self.max_pending_duration <= 0:
            raise ValueError("spillback needs a positive max_pending_duration")
        if self.recording_interval <= 0:
            raise ValueError("recording_interval must be positive")


@dataclass(frozen=True)
class LearningModel:
    type: str = "Linear"
    value: float | None = None


@dataclass(frozen=True)
class SimulationParameters:
    input_files: dict
    period: tuple[float, float]
    output_directory: str = ""
    init_iteration_counter: int = 1
    max_iterations: int = 1
    departure_time_interval: float = 60.0
    road_network: RoadNetwork | None = None
    learning_model: LearningModel = field(default_factory=LearningModel)
    update_ratio: float = 1.0
    random_seed: int | None = None
    nb_threads: int = 0
    saving_format: str = "Parquet"
    only_compute_decisions: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.period[0] < self.period[1]:
            raise ValueError("the period must be a start of 0 or more and a later end")


@dataclass(frozen=True)
class RoutingParameters:
    input_files: dict
    output_directory: str = ""
    algorithm: str = "Best"
    saving_format: str = "Parquet"
    output_order: bool = False
    output_overlay: bool = False
    output_route: bool = False
    nb_threads: int = 0
    contraction: Contraction = field(default_factory=Contraction)


def _located(values: dict, path: str) -> dict:
    """File names are relative to the parameter file."""
    base = path.rpartition("/")[0] if "://" in path else os.path.dirname(os.path.abspath(path))
    files = {k: v if "://" in v or os.path.isabs(v) else os.path.join(base, v) for k, v in values.get("input_files", {}).items() if v}
    out = values.get("output_directory", "")
    return values | {"input_files": files, "output_directory": out if "://" in out or os.path.isabs(out) else os.path.join(base, out)}


def simulation_parameters(path: str) -> SimulationParameters:
    values = _located(read_json(path), path)
    values["period"] = tuple(map(float, values["period"]))
    if values.get("road_network"):
        road = dict(values["road_network"])
        if road.get("contraction"):
            road["contraction"] = Contraction(**road["contraction"])
        values["road_network"] = _known(RoadNetwork, road)
    if values.get("learning_model"):
        values["learning_model"] = _known(LearningModel, values["learning_model"])
    return _known(SimulationParameters, values)


def routing_parameters(path: str) -> RoutingParameters:
    values = _located(read_json(path), path)
    if values.get("contraction"):
        values["contraction"] = Contraction(**values["contraction"])
    return _known(RoutingParameters, values)
