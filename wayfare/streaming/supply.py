"""Within-day model: vehicles on edges as discrete events.

Vehicles meet only on edges, so trips split into components that share no edge; each
component is one group of ``applyInPandas`` and runs as a sequence of events (a dense city is one
component).  Single gates without spillback need no events at all: see ``gates``.

Events of one time run in the order in which they were scheduled; those that another one
sets off at once run inside it.
"""

from __future__ import annotations

import heapq
import logging
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

log = logging.getLogger("wayfare")
MOST_WARNINGS = 20

OPEN, CLOSED, FULL = "open", "closed", "full"


@dataclass
class Vehicle:
    headway: float
    pce: float = 1.0
    speed: Callable[[float], float] = lambda base: base


@dataclass
class Edge:
    id: object
    length: float
    speed: float
    lanes: float = 1.0
    flow: Callable[[float], float] | None = None
    density: Callable[[float, float, float], float] | None = None
    constant_travel_time: float = 0.0
    overtaking: bool = True

    def travel_time(self, vehicle: Vehicle, occupied: float = 0.0) -> float:
        base = vehicle.speed(self.speed)
        speed = self.density(base, occupied, self.length * self.lanes) if self.density else base
        return self.length / speed + self.constant_travel_time


def density_rule(r: dict) -> Callable[[float, float, float], float] | None:
    """The speed of an edge (base, occupied length, whole length) by its columns speed_density_*; none at free flow."""
    density = None
    kind = r["speed_density_type"]
    if kind == "Bottleneck":
        density = lambda base, occ, total, c=r["speed_density_capacity"]: base if total == 0 or occ <= c * total / base else total / occ * c
    elif kind == "ThreeRegimes":
        lo, jam, slow, beta = (r[f"speed_density_{k}"] for k in ("min_density", "jam_density", "jam_speed", "beta"))

        def density(base: float, occ: float, total: float) -> float:
            d = occ / total if total else 0.0
            if d >= jam:
                return min(slow, base)
            if d > lo:
                c = ((d - lo) / (jam - lo)) ** beta
                return min(base * (1 - c) + slow * c, base)
            return base

    return density


@dataclass
class Leg:
    """A road leg has a vehicle; ``route`` None asks the router at departure.  A virtual leg has a travel time of time."""

    id: object
    vehicle: Vehicle | None = None
    origin: object = None
    destination: object = None
    route: list | None = None
    travel_time: Callable[[float], float] | None = None
    stopping: float = 0.0


@dataclass
class Trip:
    id: object
    departure: float
    legs: list[Leg]
    origin_delay: float = 0.0


@dataclass
class LegResult:
    leg: object
    departure: float
    arrival: float = 0.0
    road_time: float = 0.0
    in_bottleneck: float = 0.0
    out_bottleneck: float = 0.0
    expected_arrival: float | None = None
    route: list[tuple[object, float]] = field(default_factory=list)


@dataclass
class TripResult:
    trip: object
    departure: float
    arrival: float | None = None
    legs: list[LegResult] = field(default_factory=list)


class _Gate:
    def __init__(self) -> None:
        self.status = OPEN
        self.queue: deque = deque()


class _Segment:
    """State of an edge: entry gate, vehicles on it, exit gate, and what was observed."""

    def __init__(self, edge: Edge, spillback: bool, constrain_inflow: bool):
        self.edge = edge
        self.entry, self.exit = _Gate(), _Gate()
        self.available = edge.length * edge.lanes if spillback else None
        self.inflow = edge.flow if constrain_inflow else None
        self.occupied = 0.0

    @property
    def full(self) -> bool:
        return self.available is not None and self.available < 0

    def closing(self, flow, pce: float, t: float) -> float:
        return pce / (flow(t) * self.edge.lanes) if flow else 0.0


class _Agent:
    """A vehicle on its trip; its next step is a method of the simulation."""

    def __init__(self, trip: Trip):
        self.trip, self.leg, self.place = trip, -1, 0
        self.time = self.since = trip.departure
        self.phantom = self.was_phantom = False
        self.result = TripResult(trip.id, trip.departure)
        self.route: list = []
        self.step = None


class Simulation:
    """Runs trips over edges to the end."""

    def __init__(self, edges: list[Edge], spillback: bool = False, constrain_inflow: bool = True, max_pending: float = 0.0, wave_speed: float | None = None, router=None, phantom_fix: bool = False):
        if spillback and max_pending <= 0:
            raise ValueError("spillback needs a positive max_pending_duration")
        self.segments = {e.id: _Segment(e, spillback, constrain_inflow) for e in edges}
        self.max_pending, self.wave_speed, self.router, self.phantom_fix = max_pending, wave_speed, router, phantom_fix
        self.heap: list = []
        self.count = self.forced = 0
        self.pending: dict[int, object] = {}
        #: (edge, "entry" or "exit", time, waiting time) and (edge, time, occupied length before)
        self.waits: list[tuple] = []
        self.lengths: list[tuple] = []

    def _at(self, t: float, what, *args) -> None:
        self.count += 1
        heapq.heappush(self.heap, (t, self.count, what, args))

    def run(self, trips: list[Trip]) -> list[TripResult]:
        agents = [_Agent(t) for t in trips]
        for a in agents:
            a.step = self._starts
            self._at(a.time, self._do, a)
        while self.heap:
            t, _, what, args = heapq.heappop(self.heap)
            what(t, *args)
        return [a.result for a in agents]

    def _do(self, t: float, a: _Agent) -> None:
        """Execute the agent's step now; what it is ready to do next is scheduled."""
        a.time = t
        if a.step(t, a):
            self._at(a.time, self._do, a)

    def _next(self, a: _Agent, step, delay: float = 0.0) -> None:
        a.since = a.time
        a.was_phantom, a.phantom = a.phantom or (self.phantom_fix and step == self._reaches_exit and a.was_phantom), False
        a.step = step
        a.time += delay

    # steps of a vehicle: True if the next one is ready

    def _starts(self, t: float, a: _Agent) -> bool:
        self._next(a, None, a.trip.origin_delay)
        self._next_leg(a)
        return True

    def _next_leg(self, a: _Agent) -> None:
        a.leg += 1
        if a.leg >= len(a.trip.legs):
            a.step = self._ends
        else:
            a.step = self._begins_virtual if a.trip.legs[a.leg].vehicle is None else self._begins_road

    def _ends(self, t: float, a: _Agent) -> bool:
        a.result.arrival = t
        return False

    def _begins_virtual(self, t: float, a: _Agent) -> bool:
        leg = a.trip.legs[a.leg]
        spent = leg.travel_time(t)
        a.result.legs.append(LegResult(leg.id, t, t + spent))
        self._next(a, None, spent + leg.stopping)
        self._next_leg(a)
        return True

    def _begins_road(self, t: float, a: _Agent) -> bool:
        leg = a.trip.legs[a.leg]
        got = LegResult(leg.id, t)
        a.route = leg.route
        if a.route is None:
            if leg.origin == leg.destination:
                a.route = []
            else:
                found = self.router(leg, t) if self.router else None
                if found is None:
                    raise ValueError(f"no route from {leg.origin} to {leg.destination} at {t}")
                got.expected_arrival, a.route = found
        a.result.legs.append(got)
        a.place = 0
        self._next(a, self._reaches_entry if a.route else self._ends_road)
        return True

    def _reaches_entry(self, t: float, a: _Agent) -> bool:
        a.result.legs[-1].out_bottleneck += t - a.since
        s = self.segments[a.route[a.place]]
        self._next(a, self._enters)
        if s.entry.status == OPEN and not s.full:
            self.waits.append((s.edge.id, "entry", t, 0.0))
            s.entry.status = CLOSED
            return True
        s.entry.queue.append((t, a))
        if s.entry.status == OPEN:
            self._fill(t, s)
        return False

    def _fill(self, t: float, s: _Segment) -> None:
        s.entry.status = FULL
        head = s.entry.queue[0][1]
        self.pending[id(head)] = s.edge.id
        self._at(t + self.max_pending, self._force, head, s.edge.id)

    def _enters(self, t: float, a: _Agent) -> bool:
        got = a.result.legs[-1]
        got.in_bottleneck += t - a.since
        got.route.append((a.route[a.place], t))
        s, vehicle = self.segments[a.route[a.place]], a.trip.legs[a.leg].vehicle
        self.pending.pop(id(a), None)
        if s.available is not None and not a.phantom:
            s.available -= vehicle.headway
        s.entry.status = CLOSED
        closing = s.closing(s.inflow, vehicle.pce, t)
        spent = s.edge.travel_time(vehicle, s.occupied)
        self.lengths.append((s.edge.id, t, s.occupied))
        s.occupied += vehicle.headway
        if closing == 0:
            self._open_entry(t, s)
        else:
            self._at(t + closing, self._open_entry, s)
        if a.place > 0:
            self._release(t, self.segments[a.route[a.place - 1]], vehicle, a.was_phantom)
        self._next(a, self._reaches_exit, spent)
        return True

    def _reaches_exit(self, t: float, a: _Agent) -> bool:
        a.result.legs[-1].road_time += t - a.since
        s, vehicle = self.segments[a.route[a.place]], a.trip.legs[a.leg].vehicle
        self._next(a, None)
        a.place += 1
        a.step = self._ends_road if a.place == len(a.route) else self._reaches_entry
        if s.exit.status != OPEN:
            s.exit.queue.append((t, a))
            return False
        self.waits.append((s.edge.id, "exit", t, 0.0))
        s.exit.status = CLOSED
        if s.edge.overtaking:
            closing = s.closing(s.edge.flow, vehicle.pce, t)
            if closing == 0:
                s.exit.status = OPEN
            else:
                self._at(t + closing, self._open_exit, s)
        return True

    def _ends_road(self, t: float, a: _Agent) -> bool:
        leg, got = a.trip.legs[a.leg], a.result.legs[-1]
        got.out_bottleneck += t - a.since
        got.arrival = got.departure + got.road_time + got.in_bottleneck + got.out_bottleneck
        if a.route:
            self._release(t, self.segments[a.route[-1]], leg.vehicle, a.phantom or (self.phantom_fix and a.was_phantom))
        self._next(a, None, leg.stopping)
        self._next_leg(a)
        return True

    # gates

    def _open_entry(self, t: float, s: _Segment) -> None:
        if not s.entry.queue:
            s.entry.status = OPEN
        elif s.full:
            self._fill(t, s)
        else:
            s.entry.status = CLOSED
            self._pop_entry(t, s)

    def _pop_entry(self, t: float, s: _Segment, phantom: bool = False) -> None:
        came, head = s.entry.queue.popleft()
        self.waits.append((s.edge.id, "entry", came, t - came))
        head.phantom = phantom
        self._do(t, head)

    def _open_exit(self, t: float, s: _Segment) -> None:
        while True:
            if not s.exit.queue:
                s.exit.status = OPEN
                return
            came, head = s.exit.queue.popleft()
            self.waits.append((s.edge.id, "exit", came, t - came))
            closing = s.closing(s.edge.flow, head.trip.legs[head.leg].vehicle.pce, t) if s.edge.overtaking else None
            self._do(t, head)
            if closing is None:
                return
            if closing > 0:
                self._at(t + closing, self._open_exit, s)
                return

    def _release(self, t: float, s: _Segment, vehicle: Vehicle, was_phantom: bool) -> None:
        if not s.edge.overtaking:
            closing = s.closing(s.edge.flow, vehicle.pce, t)
            if closing == 0:
                self._open_exit(t, s)
            else:
                self._at(t + closing, self._open_exit, s)
        if self.wave_speed:
            self._at(t + s.edge.length / self.wave_speed, self._freed, s, vehicle.headway, was_phantom)
        else:
            self._freed(t, s, vehicle.headway, was_phantom)

    def _freed(self, t: float, s: _Segment, headway: float, was_phantom: bool) -> None:
        released = False
        if not was_phantom and s.available is not None:
            s.available += headway
            released = s.entry.status == FULL and not s.full
        s.occupied = max(0.0, s.occupied - headway)
        if released:
            self._pop_entry(t, s)

    def _force(self, t: float, a: _Agent, edge: object) -> None:
        if self.pending.get(id(a)) == edge:
            self.forced += 1
            if self.forced <= MOST_WARNINGS:
                log.warning("trip %s is released by force to edge %s at %s", a.trip.id, edge, t)
            self._pop_entry(t, self.segments[edge], phantom=True)
