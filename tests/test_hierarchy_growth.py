"""The making of a hierarchy looks again only at nodes around those that it contracted."""

from wayfare.operators.graph import Graph
from wayfare.operators.hierarchy import Hierarchy


def _network(n):
    """The derived network: from each node to the next one and to one to three times its number."""
    ends = [(2 * s + k, s, to % n) for s in range(n) for k, to in enumerate((s + 1, s + 3 if (2 * s + 5) % n in (0, 1) else 3 * s + 5))]
    return Graph((e, s, t, (500.0 + 100 * (e % 7)) / (8.0 + e % 5)) for e, s, t in ends)


def test_looks_at_a_node_do_not_grow_with_the_graph(monkeypatch):
    looks, near = [], Hierarchy._near
    monkeypatch.setattr(Hierarchy, "_near", lambda self, node: looks.append(node) or near(self, node))
    a_node = []
    for n in (500, 2000):
        looks.clear()
        h = Hierarchy(_network(n))
        a_node.append(len(looks) / n)
        assert sorted(h.order.values()) == list(range(n)) and n / 2 < h.rim < n
    assert a_node[1] < 1.5 * a_node[0] < 150


def test_contracted_nodes_are_least_around_them():
    """Each set holds all nodes of least cost within two steps, as if all were looked at again."""
    class Checked(Hierarchy):
        def _sets(self, order):
            left, cost = set(self.graph.nodes), {}
            index = {n: i for i, n in enumerate(sorted(left, key=str))}
            cost = {n: self._cost(n) for n in left}
            for chosen in super()._sets(order):
                two = {n: {m for k in self._near(n) for m in (k, *self._near(k))} - {n} for n in left}
                assert chosen == sorted((n for n in left if cost[n] < float("inf") and all((cost[n], index[n]) < (cost[m], index[m]) for m in two[n])), key=index.get)
                beside = {m for c in chosen for m in self._near(c)}
                yield chosen
                left -= set(chosen)
                cost.update({n: self._cost(n) for n in beside & left})
            assert all(c == float("inf") for n, c in cost.items() if n in left)

    Checked(_network(150))
