"""A contraction hierarchy of travel-time functions, with routes.

Nodes are contracted in sets that do not touch: of all nodes left, those whose cost is least among the nodes two steps around.  A
shortcut remembers, for each point of the grid, what it stands for (an edge, or the node between its halves), so that a way over shortcuts
is unpacked to edges at the time it is taken.

Of a large graph the nodes with many ways, whose contraction would join all to all, stay together as the core on top of the order: its
ways are all taken upward, so that a search from below crosses it as a plain one and meets the other side at its rim.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from wayfare.operators.graph import Function, Graph, ProfileSide, bounds, corridor, interval_search, meet

#: Nodes of a graph that is contracted to the last one whatever it costs.
WHOLE = 100
#: Ways in times ways out beyond which a node of a larger graph is not contracted.
MOST_PAIRS = 8
#: Departures at which a witness is tried before its whole function.
SAMPLES = 5


class Way:
    """An edge of the overlay: its function, the number of edges in it, its parts (("edge", id) or ("via", node)) and which one is least at each grid point."""

    __slots__ = ("f", "size", "parts", "least")

    def __init__(self, f: Function, size: int, parts: list[tuple[str, object]], least: np.ndarray | int = 0):
        self.f, self.size, self.parts, self.least = f, size, parts, least

    def merged(self, other: Way) -> Way:
        """The lesser of both at every time; what is least nowhere is forgotten."""
        if np.all(self.f <= other.f):
            return self
        if np.all(other.f <= self.f):
            return other
        first = np.broadcast_to(self.f, np.shape(other.f)) if np.ndim(self.f) == 0 else self.f
        second = np.broadcast_to(other.f, first.shape)
        takes = second < first
        least = np.where(takes, np.asarray(other.least) + len(self.parts), np.asarray(self.least))
        used = np.unique(least)
        parts = [*self.parts, *other.parts]
        return Way(np.minimum(first, second), max(self.size, other.size), [parts[k] for k in used], np.searchsorted(used, least))


class Hierarchy:
    """Overlay of a graph; ``order`` gives each node's place.  Edges that can never be passed are not in the graph."""

    def __init__(self, graph: Graph, order: dict | None = None, weights: tuple[float, float, float, float] = (2, 1, 1, 2), hops: int = 16):
        self.graph, self.hops, self.weights = graph, hops, weights
        self.up: dict[object, dict[object, Way]] = {}
        self.down: dict[object, dict[object, Way]] = {}
        self._out: dict[object, dict[object, Way]] = {n: {} for n in graph.nodes}
        self._into: dict[object, dict[object, Way]] = {n: {} for n in graph.nodes}
        self._target = {}
        for source, edges in graph.out.items():
            for edge, target in edges:
                self._target[edge] = target
                if source != target:
                    self._put(source, target, Way(graph.functions[edge], 1, [("edge", edge)]))
        self.order: dict[object, int] = {}
        self.depth = dict.fromkeys(graph.nodes, 0)
        for chosen in self._sets(order):
            for node in chosen:  # each sees what the one before left, so that no two are one another's witness
                self._contract(node, self._shortcuts(node))
        self.rim = len(self.order)
        for node in sorted(graph.nodes - self.order.keys(), key=str):
            self.order[node] = len(self.order)
            self.up[node], self.down[node] = self._out[node], {}
        del self._out, self._into

    # --- construction ---------------------------------------------------------------------

    def _put(self, source, target, way: Way) -> None:
        old = self._out[source].get(target)
        way = way if old is None else old.merged(way)
        self._out[source][target] = self._into[target][source] = way

    def _near(self, node) -> set:
        return self._out[node].keys() | self._into[node].keys()

    def _sets(self, order: dict | None) -> Iterator[list]:
        """Sets of nodes to contract together."""
        index = {n: i for i, n in enumerate(sorted(self.graph.nodes, key=str))}
        if order is not None:
            line, at = sorted(index, key=lambda n: (order[n], index[n])), 0
            while at < len(line):
                chosen: list = []
                touched: set = set()
                while at < len(line) and line[at] not in touched:
                    chosen.append(line[at])
                    touched |= self._near(line[at])
                    at += 1
                yield chosen
            return
        left = set(index)
        rank = {n: (self._cost(n), index[n]) for n in left}
        open_ = left
        while chosen := sorted((n for n in open_ if np.isfinite(rank[n][0]) and self._is_least(n, rank)), key=index.get):
            around = {n: self._near(n) for n in chosen}
            yield chosen
            left.difference_update(chosen)
            moved = set().union(*around.values()) & left
            for n in moved:
                rank[n] = self._cost(n), index[n]
            # only what has one of these within two steps may have become the least around it
            near = moved.union(*map(self._near, moved))
            open_ = near.union(*map(self._near, near))

    def _is_least(self, node, rank: dict) -> bool:
        """Whether no node within two steps is of a lesser rank."""
        own, near = rank[node], self._near(node)
        return all(own < rank[m] for m in near) and all(own <= rank[m] for k in near for m in self._near(k))

    def _cost(self, node) -> float:
        if len(self.graph.nodes) > WHOLE and len(self._into[node]) * len(self._out[node]) > MOST_PAIRS:
            return np.inf
        made = self._shortcuts(node)
        removed = [*self._into[node].values(), *self._out[node].values()]
        if not removed:
            return self.weights[1] * self.depth[node]
        quotients = (len(made) / len(removed), self.depth[node], sum(w.size for _, _, w in made) / sum(w.size for w in removed), sum(np.size(w.f) for _, _, w in made) / sum(np.size(w.f) for w in removed))
        return sum(w * q for w, q in zip(self.weights, quotients, strict=True))

    def _shortcuts(self, node) -> list[tuple[object, object, Way]]:
        made = []
        for source, first in self._into[node].items():
            for target, second in self._out[node].items():
                if source != target:
                    way = Way(self.graph.link(first.f, second.f), first.size + second.size, [("via", node)])
                    if not self._witness(source, target, node, way.f):
                        made.append((source, target, way))
        return made

    def _witness(self, source, target, without, new: Function) -> bool:
        """Whether a way of a few hops past the node is as fast at all times: by bounds, then at some departures, then by its function, the
        last two within the corridor that the bounds leave."""

        def ways(n):
            return ((None, to, w.f) for to, w in self._out[n].items() if to != without)

        low, high = bounds(new)
        label, before = interval_search(source, ways, {target}, self.hops, without, bound=high)
        if target not in label:
            return False
        if label[target][1] <= low:
            return True
        inside = corridor(before, target)
        if np.ndim(new):
            grid = self.graph.grid.xs
            for k in range(0, len(grid), max(1, len(grid) // SAMPLES)):
                if self._spent(source, target, grid[k], inside, without) > new[k]:
                    return False
        side = ProfileSide(source, lambda n: ((to, w.f) for to, w in self._out[n].items() if to in inside and to != without), self.graph.link)
        while side.key <= high:
            side.settle()
        return target in side.label and bool(np.all(side.label[target] <= new))

    def _spent(self, source, target, departure: float, inside: set, without) -> float:
        reached, done, heap, count = {source: departure}, set(), [(departure, 0, source)], 0
        while heap:
            t, _, node = heapq.heappop(heap)
            if node == target:
                return t - departure
            if node in done:
                continue
            done.add(node)
            for to, way in self._out[node].items():
                if to in inside and to != without:
                    at = t + self.graph.evaluate(way.f, t)
                    if at < reached.get(to, np.inf):
                        reached[to] = at
                        count += 1
                        heapq.heappush(heap, (at, count, to))
        return np.inf

    def _contract(self, node, made) -> None:
        self.order[node] = len(self.order)
        self.up[node], self.down[node] = dict(self._out[node]), dict(self._into[node])
        for n in self._near(node):
            self.depth[n] = max(self.depth[n], self.depth[node] + 1)
        for source in self._into.pop(node):
            del self._out[source][node]
        for target in self._out.pop(node):
            del self._into[target][node]
        for source, target, way in made:
            self._put(source, target, way)

    # --- figures --------------------------------------------------------------------------

    @property
    def edges(self) -> int:
        return sum(len(w) for w in (*self.up.values(), *self.down.values()))

    @property
    def complexity(self) -> int:
        """Points of all functions; a constant has none."""
        return sum(np.size(w.f) for ways in (*self.up.values(), *self.down.values()) for w in ways.values() if np.ndim(w.f))

    # --- queries --------------------------------------------------------------------------

    def forward_space(self, origin: object) -> dict[object, Function]:
        """Functions from the origin to the hubs above it."""
        return self._space(origin, self.up, lambda f, g: self.graph.link(f, g))

    def backward_space(self, target: object) -> dict[object, Function]:
        """Functions from the hubs above the target to it."""
        return self._space(target, self.down, lambda f, g: self.graph.link(g, f))

    def _space(self, start, edges, link) -> dict[object, Function]:
        label, heap, queued = {start: 0.0}, [(self.order[start], 0.0, 0, start)], {start}
        count = 0
        while heap:  # in contraction order: a node is final when it is popped; in the core, until no label improves
            *_, node = heapq.heappop(heap)
            if node not in queued:
                continue
            queued.discard(node)
            for to, way in edges[node].items():
                new, old = link(label[node], way.f), label.get(to)
                if old is not None:
                    if not np.any(new < old):
                        continue
                    new = np.minimum(old, new)
                label[to] = new
                queued.add(to)
                count += 1
                heapq.heappush(heap, (min(self.order[to], self.rim), float(np.min(new)), count, to))
        return label

    def profile(self, origin: object, target: object) -> Function | None:
        """Travel-time function, searched upward from both ends by turns."""
        if origin == target:
            return 0.0
        forward = ProfileSide(origin, lambda n: ((to, w.f) for to, w in self.up[n].items()), self.graph.link)
        backward = ProfileSide(target, lambda n: ((to, w.f) for to, w in self.down[n].items()), lambda f, g: self.graph.link(g, f))
        return meet(forward, backward, self.graph.link)

    def interval(self, origin: object, target: object) -> tuple[float, float] | None:
        """Bounds of the travel time, searched upward from both ends."""
        ahead, _ = interval_search(origin, lambda n: ((None, to, w.f) for to, w in self.up[n].items()), stall=lambda n: ((m, w.f) for m, w in self.down[n].items()))
        back, _ = interval_search(target, lambda n: ((None, to, w.f) for to, w in self.down[n].items()), stall=lambda n: ((m, w.f) for m, w in self.up[n].items()))
        both = ahead.keys() & back.keys()
        return (min(ahead[n][0] + back[n][0] for n in both), min(ahead[n][1] + back[n][1] for n in both)) if both else None

    def earliest(self, origin: object, target: object, departure: float) -> float | None:
        found = self.earliest_route(origin, target, departure)
        return None if found is None else found[0]

    def earliest_route(self, origin: object, target: object, departure: float) -> tuple[float, list] | None:
        """Arrival time and edges: upward by time from the origin, and down over the ways that lead to the target.

        The ways down are those that a search of bounds from the target finds; what is reached after the latest arrival they allow is not searched on from.
        """
        if origin == target:
            return departure, []
        back, _ = interval_search(target, lambda n: ((None, to, w.f) for to, w in self.down[n].items()))
        falls: dict[object, dict[object, Way]] = {}
        for node in back:
            for source, way in self.down[node].items():
                if source in back:
                    falls.setdefault(source, {})[node] = way
        reached, last, done, bound = {origin: departure}, {}, set(), np.inf
        heap, count = [(departure, 0, origin)], 0
        while heap:
            t, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            if node == target:
                break
            if node in back:
                bound = min(bound, t + back[node][1])
            if t > bound:
                break
            for to, way in (*self.up[node].items(), *falls.get(node, {}).items()):
                at = t + self.graph.evaluate(way.f, t)
                if at < reached.get(to, np.inf):
                    reached[to], last[to] = at, (node, way)
                    count += 1
                    heapq.heappush(heap, (at, count, to))
        if target not in done:
            return None
        steps, node = [], target
        while node != origin:
            before, way = last[node]
            steps.append((before, node, way))
            node = before
        route, t = [], departure
        for source, end, way in reversed(steps):
            t, part = self.unpack(source, end, way, t)
            route += part
        return self._without_loops(origin, route, departure)

    def unpack(self, source: object, target: object, way: Way, t: float) -> tuple[float, list]:
        """Arrival and edges of a way entered at t."""
        best: tuple[float, list] | None = None
        for k in self._candidates(way, t):
            kind, of = way.parts[k]
            if kind == "edge":
                found = t + self.graph.evaluate(self.graph.functions[of], t), [of]
            else:
                middle, first = self.unpack(source, of, self.down[of][source], t)
                end, second = self.unpack(of, target, self.up[of][target], middle)
                found = end, first + second
            if best is None or found[0] < best[0]:
                best = found
        return best

    def _candidates(self, way: Way, t: float) -> set[int]:
        """The parts that are least at the grid points around t."""
        if np.ndim(way.least) == 0:
            return {int(way.least)}
        place = (t - self.graph.grid.start) / self.graph.grid.interval
        k = min(max(int(np.floor(place)), 0), len(way.least) - 1)
        return {int(way.least[k]), int(way.least[min(k + 1, len(way.least) - 1)])}

    def _without_loops(self, origin: object, route: list, departure: float) -> tuple[float, list]:
        """The route cut short wherever it comes back to a node, and its arrival."""
        nodes, kept = [origin], []
        for edge in route:
            to = self._target[edge]
            if to in nodes:
                at = nodes.index(to)
                nodes, kept = nodes[: at + 1], kept[:at]
            else:
                nodes.append(to)
                kept.append(edge)
        t = departure
        for edge in kept:
            t += self.graph.evaluate(self.graph.functions[edge], t)
        return t, kept
