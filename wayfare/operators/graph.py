"""Searches on one graph in memory: what a function on a worker needs.

Edges have constant travel times or values on one shared grid, so that a profile is one numpy
vector and linking and merging are vector operations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Grid:
    start: float
    interval: float
    size: int

    @property
    def xs(self) -> np.ndarray:
        return self.start + self.interval * np.arange(self.size)


Function = float | np.ndarray


class Graph:
    """Directed graph; ``functions`` by edge id, a float or the values on ``grid``."""

    def __init__(self, edges: Iterable[tuple[object, object, object, Function]], grid: Grid | None = None):
        self.grid = grid
        self.out: dict[object, list[tuple[object, object]]] = {}
        self.into: dict[object, list[tuple[object, object]]] = {}
        self.functions: dict[object, Function] = {}
        self.nodes: set = set()
        self._bounds: dict[object, tuple[float, float]] = {}
        for edge, source, target, f in edges:
            self.nodes.update((source, target))
            if np.ndim(f) == 0 and not np.isfinite(f):
                continue  # closed
            self.functions[edge] = f
            self.out.setdefault(source, []).append((edge, target))
            self.into.setdefault(target, []).append((edge, source))

    def evaluate(self, f: Function, x: float) -> float:
        if np.ndim(f) == 0:
            return float(f)
        place = (x - self.grid.start) / self.grid.interval
        if place >= self.grid.size - 1:
            return float(f[-1])
        if place <= 0:
            return float(f[0])
        k = int(place)
        return float(f[k] + (place - k) * (f[k + 1] - f[k]))

    def link(self, f: Function, g: Function) -> Function:
        if np.ndim(g) == 0:
            return f + g
        if np.ndim(f) == 0 and f == 0:
            return g
        xs = self.grid.xs + f
        return f + np.interp(xs, self.grid.xs, g)

    def earliest(self, origin: object, departure: float, targets: set | None = None, bound: float = np.inf) -> tuple[dict, dict]:
        """Arrival time and last edge of every node reached, until all targets are settled."""
        return self.earliest_from({origin: departure}, targets, bound)

    def earliest_from(self, sources: dict, targets: set | None = None, bound: float = np.inf, hops: int | None = None) -> tuple[dict, dict]:
        """The same from several nodes with their own times; ``bound`` cuts later arrivals, ``hops`` longer paths."""
        arrival, last, done = dict(sources), {}, set()
        steps = dict.fromkeys(sources, 0)
        left = set(targets) if targets is not None else None
        heap, count = [(t, i, n) for i, (n, t) in enumerate(sources.items())], len(sources)
        heapq.heapify(heap)
        while heap:
            t, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            if left is not None:
                left.discard(node)
                if not left:
                    break
            if hops is not None and steps[node] >= hops:
                continue
            for edge, to in self.out.get(node, ()):
                if to in done:
                    continue
                at = t + self.evaluate(self.functions[edge], t)
                if at < arrival.get(to, bound):
                    arrival[to], last[to], steps[to] = at, (edge, node), steps[node] + 1
                    count += 1
                    heapq.heappush(heap, (at, count, to))
        return {n: arrival[n] for n in done}, last

    def path(self, last: dict, origin: object, target: object) -> list:
        """Edges to the target; fails on a loop."""
        out, seen, node = [], {target}, target
        while node != origin:
            edge, node = last[node]
            if node in seen:
                raise ValueError(f"the route to {target} loops at {node}")
            seen.add(node)
            out.append(edge)
        return out[::-1]

    def earliest_route(self, origin: object, target: object, departure: float) -> tuple[float, list] | None:
        if origin == target:
            return departure, []
        arrival, last = self.earliest(origin, departure, {target})
        return (arrival[target], self.path(last, origin, target)) if target in arrival else None

    def profile(self, origin: object, targets: set | None = None) -> dict[object, Function]:
        """Travel-time functions from the origin; labels are corrected until none improves.

        A node waits in the queue under its least value; once that is above the greatest value of every target, nothing can improve.
        """
        label: dict[object, Function] = {origin: 0.0}
        heap, count, queued = [(0.0, 0, origin)], 0, {origin}
        while heap:
            key, _, node = heapq.heappop(heap)
            if node not in queued:
                continue
            queued.discard(node)
            if targets is not None and all(t in label for t in targets) and key > max(float(np.max(label[t])) for t in targets):
                break
            for edge, to in self.out.get(node, ()):
                new = self.link(label[node], self.functions[edge])
                old = label.get(to)
                if old is not None:
                    if not np.any(new < old):
                        continue
                    new = np.minimum(old, new)
                label[to] = new
                queued.add(to)
                count += 1
                heapq.heappush(heap, (float(np.min(new)), count, to))
        return label if targets is None else {t: label[t] for t in targets if t in label}

    def reversed_profile(self, target: object) -> dict[object, Function]:
        """Travel-time functions to the target from every node."""
        label: dict[object, Function] = {target: 0.0}
        heap, count, queued = [(0.0, 0, target)], 0, {target}
        while heap:
            _, _, node = heapq.heappop(heap)
            if node not in queued:
                continue
            queued.discard(node)
            for edge, source in self.into.get(node, ()):
                new = self.link(self.functions[edge], label[node])
                old = label.get(source)
                if old is not None:
                    if not np.any(new < old):
                        continue
                    new = np.minimum(old, new)
                label[source] = new
                queued.add(source)
                count += 1
                heapq.heappush(heap, (float(np.min(new)), count, source))
        return label

    # --- bounds ---------------------------------------------------------------------------

    def intervals(self, origin: object, targets: set | None = None, hops: int | None = None, without: object = None, forward: bool = True) -> tuple[dict, dict]:
        """Least and greatest travel time to every node reached (from it, if not ``forward``), and each node's two best predecessors by the least one."""
        if len(self._bounds) != len(self.functions):
            self._bounds = {e: bounds(f) for e, f in self.functions.items()}
        near = self.out if forward else self.into

        def ways(n):
            return ((e, to, self._bounds[e]) for e, to in near.get(n, ()))

        return interval_search(origin, ways, targets, hops, without)

    def two_way(self, origin: object, target: object) -> tuple[float, list] | None:
        """Least time and edges between two nodes of a graph of constants, searched from both ends by turns."""
        if origin == target:
            return 0.0, []
        sides = [Side(origin, lambda n: ((e, to, float(self.functions[e])) for e, to in self.out.get(n, ()))), Side(target, lambda n: ((e, to, float(self.functions[e])) for e, to in self.into.get(n, ())))]
        best, meeting = np.inf, None
        while sides[0].key + sides[1].key < best:
            own, other = sides if sides[0].key <= sides[1].key else sides[::-1]
            node = own.settle()
            if node in other.label and own.label[node] + other.label[node] < best:
                best, meeting = own.label[node] + other.label[node], node
        if meeting is None:
            return None
        before, after = (side.path(meeting) for side in sides)
        return best, before[::-1] + after

    def two_way_profile(self, origin: object, target: object) -> Function | None:
        """The travel-time function between two nodes, from both ends by turns; a side stops at the greatest value found."""
        if origin == target:
            return 0.0
        forward = ProfileSide(origin, lambda n: ((to, self.functions[e]) for e, to in self.out.get(n, ())), self.link)
        backward = ProfileSide(target, lambda n: ((to, self.functions[e]) for e, to in self.into.get(n, ())), lambda f, g: self.link(g, f))
        return meet(forward, backward, self.link)


def bounds(f: Function | tuple[float, float]) -> tuple[float, float]:
    """Least and greatest value of a function; of a pair of them, the pair."""
    return f if isinstance(f, tuple) else (f, f) if isinstance(f, float) else (float(np.min(f)), float(np.max(f)))


def interval_search(origin, ways, targets=None, hops=None, without=None, stall=None, bound=np.inf) -> tuple[dict, dict]:
    """Labels (least, greatest) and up to two predecessors by least value; ``ways(node)`` gives (edge, to, function).  Nothing above ``bound`` is searched.

    With ``stall(node)``, the (other node, function) of ways into the node that the search itself does not take, a node is not searched on
    from if such a way is faster at its greatest value than the node's label at its least.
    """
    label, before, done = {origin: (0.0, 0.0)}, {origin: []}, set()
    left, steps = set(targets) if targets is not None else None, {origin: 0}
    heap, count = [(0.0, 0, origin)], 0
    while heap:
        low, _, node = heapq.heappop(heap)
        if node in done and low > label[node][0]:
            continue
        done.add(node)
        if left is not None:
            left.discard(node)
            if not left and low > max(label[t][1] for t in targets):
                break
        if hops is not None and steps[node] >= hops:
            continue
        if stall and any(m in label and label[m][1] + bounds(f)[1] < low for m, f in stall(node)):
            continue
        high = label[node][1]
        for edge, to, f in ways(node):
            if to == without:
                continue
            least, most = bounds(f)
            new = (low + least, high + most)
            old = label.get(to)
            if new[0] > bound or old is not None and new[0] > old[1]:
                continue  # never the least
            seen = [x for x in before.get(to, ()) if x[0] != node]
            before[to] = sorted([*seen, (node, edge, new[0])], key=lambda x: x[2])[:2]
            merged = new if old is None else (min(old[0], new[0]), min(old[1], new[1]))
            if merged != old:
                label[to] = merged
                steps[to] = min(steps.get(to, steps[node] + 1), steps[node] + 1)
                count += 1
                heapq.heappush(heap, (merged[0], count, to))
    return label, before


def corridor(before: dict, target: object) -> set:
    """The nodes on the ways back from the target over the predecessors kept."""
    out, stack = set(), [target]
    while stack:
        node = stack.pop()
        if node in out:
            continue
        out.add(node)
        stack += [p for p, _, _ in before.get(node, ())]
    return out


class Side:
    """One side of a search over constants."""

    def __init__(self, start: object, ways):
        self.ways, self.label, self.last, self.done = ways, {start: 0.0}, {}, set()
        self.heap, self.count, self.start = [(0.0, 0, start)], 0, start

    @property
    def key(self) -> float:
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else np.inf

    def settle(self) -> object:
        t, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        for edge, to, spent in self.ways(node):
            if t + spent < self.label.get(to, np.inf):
                self.label[to], self.last[to] = t + spent, (edge, node)
                self.count += 1
                heapq.heappush(self.heap, (t + spent, self.count, to))
        return node

    def path(self, node: object) -> list:
        """Edges from the node back to the start."""
        out = []
        while node != self.start:
            edge, node = self.last[node]
            out.append(edge)
        return out


class ProfileSide:
    """One side of a search over functions: labels are corrected, a node waits under its least value."""

    def __init__(self, start: object, ways, link):
        self.ways, self.link, self.label = ways, link, {start: 0.0}
        self.heap, self.count, self.queued = [(0.0, 0, start)], 0, {start}

    @property
    def key(self) -> float:
        while self.heap and self.heap[0][2] not in self.queued:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else np.inf

    def settle(self) -> object:
        _, _, node = heapq.heappop(self.heap)
        self.queued.discard(node)
        for to, f in self.ways(node):
            new, old = self.link(self.label[node], f), self.label.get(to)
            if old is not None:
                if not np.any(new < old):
                    continue
                new = np.minimum(old, new)
            self.label[to] = new
            self.queued.add(to)
            self.count += 1
            heapq.heappush(self.heap, (float(np.min(new)), self.count, to))
        return node


def meet(forward: ProfileSide, backward: ProfileSide, link) -> Function | None:
    """The least link over all nodes that both sides reach; a side rests once its next label is above the greatest value so far."""
    bound, places = np.inf, set()
    while True:
        open_ = [side for side in (forward, backward) if side.key < bound]
        if not open_:
            break
        own = min(open_, key=lambda s: s.key)
        node = own.settle()
        if node in forward.label and node in backward.label:
            places.add(node)
            bound = min(bound, float(np.max(forward.label[node])) + float(np.max(backward.label[node])))
    out = None
    for node in places:
        f, g = forward.label[node], backward.label[node]
        if float(np.min(f)) + float(np.min(g)) <= bound:
            h = link(f, g)
            out = h if out is None else np.minimum(out, h)
    return out
