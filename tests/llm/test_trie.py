"""Nodes of the prefix trie against a brute-force dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.llm import trie


def brute(paths: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = collections.defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in members if len(m) == len(node) + 1 and m[: len(node)] == node]
        leaves = [m for m in below if not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(ids), len(node), parent, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def some_rows(rnd: random.Random, count: int) -> list[tuple]:
    rows = []
    for c in range(count):
        if rnd.random() < 0.1:
            continue
        same = rnd.random() < 0.3
        for k in range(rnd.choice([1, 2, 3, 8, 12])):
            rows.append((c, None if k == 0 and rnd.random() < 0.2 else k, rnd.choice(["user", None, "assistant"]) if not same else "user", f"hot {k}" if same else rnd.choice(["a", "b", "é ü", "", None])))
    rnd.shuffle(rows)
    return rows


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r[c] for c in trie.RESULT) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_ranges_of_any_size_give_the_same_nodes(seed, monkeypatch):
    """Sweep and stitch without Spark: every cut of the sorted paths into ranges."""
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rnd = random.Random(seed)
    alphabet = [hashlib.sha256(bytes([k])).digest()[:16] for k in range(rnd.choice([1, 2, 5]))]
    sized = {turn: k for k, turn in enumerate(alphabet)}
    paths = {c: b"".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 2, 5]))) for c in range(rnd.randint(1, 60))}
    ordered = sorted(paths.items(), key=lambda kv: (kv[1], kv[0]))
    found = []
    for size in (1, 2, 7, 1000):
        swept = []
        for k in range(0, len(ordered), size):
            part = ordered[k : k + size]
            batch = pa.RecordBatch.from_pydict({"conv_id": [c for c, _ in part], "path": [p for _, p in part], "sizes": [[sized[p[i : i + 16]] for i in range(0, len(p), 16)] for _, p in part]})
            swept += [r for b in trie._sweep(iter([batch])) for r in b.to_pylist()]
        edges = sorted((r for r in swept if r["kind"] == "edge"), key=lambda r: (r["path"], r["first"]))
        opened = [r for b in trie._stitch(iter([pa.RecordBatch.from_pylist([e]) for e in edges])) for r in b.to_pylist()]
        pieces = sorted((r for r in swept if r["kind"] == "ids"), key=lambda r: (r["key"], r["first"]))
        ends = {k: v for b in trie._hash_pieces(iter([pa.RecordBatch.from_pylist([{"key": p["key"], "ids": p["ids"]}]) for p in pieces])) for k, v in zip(*b.to_pydict().values(), strict=True)}
        keys = {r["key"]: r["conv_id"] for r in opened}
        nodes = [r | {"parent_conv_id": keys[r["parent"]] if r["parent"] else r["parent_conv_id"]} for r in swept if r["kind"] == "node"]
        nodes += [r | {"ends_sha256": ends.get(r["key"], hashlib.sha256(b"").hexdigest())} for r in opened]
        found.append(sorted((tuple(r[c] for c in trie.RESULT) for r in nodes), key=str))
    as_turns = {c: [(str(sized[p[i : i + 16]]), "x" * sized[p[i : i + 16]]) for i in range(0, len(p), 16)] for c, p in paths.items()}
    assert all(f == brute(as_turns) for f in found)


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 3), (3, 13)])
def test_rebuilt_conversations(spark, seed, ranges):
    rows = some_rows(random.Random(seed), 120) + [(None, 1, "user", "nobody's"), (-3, 0, "user", "below"), (1000, 0, "user", "alone"), (1003, None, None, None)]
    # Spark's remainder has the sign of the dividend: -3 belongs to 0.
    expected = rebuilt([r for r in rows if r[0] != -3])
    h = zlib.crc32(b"-3") % 9
    expected[-3] = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == 0), key=lambda r: (r[1] is not None, r[1] or 0))][:h] + [("user", "below")][h:]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"path": F.lit(1), "t": F.lit(2), "base": F.lit("x")})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        assert rows_of(trie.prefix_trie(trie.rebuilt_sequences(frame))) == brute(expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_conversations_as_they_are_and_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "a"), (3, 5, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turn = ("user", "a")
    assert rows_of(trie.prefix_trie(trie.sequences(frame))) == brute({1: [turn, turn], 2: [turn, turn], 3: [turn]})


def test_empty_and_turnless(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt_sequences(frame)).count() == 0
    only_base = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its base is absent, its one turn is replaced
    frame = spark.createDataFrame([(only_base, 0, "user", "x")], frame.schema)
    assert rows_of(trie.prefix_trie(trie.rebuilt_sequences(frame))) == brute({only_base: []})


def test_a_long_conversation_and_text(spark):
    rows = [(c, k, "user", "w" * 50_000 if k == 3 else str(k)) for c in (0, 1) for k in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.depth: r for r in trie.prefix_trie(trie.rebuilt_sequences(frame)).collect()}
    assert len(got) == 1501 and got[0].n_convs == 2 and got[0].n_leaves == 1
    assert got[0].saved_tokens == sum(50_000 if k == 3 else len(str(k)) for k in range(1500))
