"""The prefix trie of conversations as a table of nodes.

A turn is 16 bytes of the SHA-256 of its role and text, a conversation the binary string of its
turns (its path): in the order of these strings conversations with the same first turns are neighbours, and one
comes before those that continue it.  Conversations are range-sorted by path and id, so that equal ones,
be they a third of all, are spread over ranges.

Each range is swept once with a stack.  The turns that two neighbours share, their LCP, close the nodes of the stack that are
deeper; a node closed within its range is complete.  The prefixes of a range's first and last path may go on in
other ranges and are left open: the range gives one row with the numbers of both stacks, and one pass over these rows, as many as
there are ranges, stitches them together.  Children of open nodes get their parent's id by a join over salted keys.  The ids of
conversations that end at an open node are given in pieces and hashed in order: a digest of one sequence cannot be split, but it is streamed.

Defined results: a null role or text is empty; turns are in the order of their number, null first, those of one
number in the order of their hashes, so that repeated rows are repeated turns; rows without a conv_id are in no conversation; an empty table has no nodes; other
columns are not read.  One conversation's turns, 40 bytes each, and what is open in one range are held by one task, no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wayfare.llm.storage import Scratch, bound_batches

#: Bytes that a turn has in a path.
WIDTH = 16
#: Conversations of a range in the mean, at most; ids of one piece.
RANGE_ROWS, PIECE_IDS = 100_000, 8192
#: Copies of the open nodes that children are joined with: one node may be the parent of a third of all.
SALTS = 16
ROOT = b"\0" * WIDTH

_LONGS = pa.list_(pa.list_(pa.int64()))
_NODE = pa.schema([("key", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]])
#: What a range gives, by kind: ``node`` (``parent`` set if that is open), ``ids`` of an open node, ``edge``.
_SWEPT = pa.schema(
    [("kind", pa.string()), ("parent", pa.binary()), *_NODE, ("ends_sha256", pa.string()), ("first", pa.int64()), ("ids", pa.string())]
    + [("path", pa.binary()), ("last_path", pa.binary()), ("first_open", _LONGS), ("last_open", _LONGS)]
)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@dataclass
class _Open:
    """A node of a stack: bytes of its turn's text, and of what is closed below it the least id, conversations, children, leaves and savings."""

    key: bytes
    size: int = 0
    least: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ids: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)

    def numbers(self) -> list[int | None]:
        return [self.size, self.least, self.convs, self.children, self.leaves, self.saved]

    def take(self, least: int | None, convs: int, children: int, leaves: int, saved: int) -> None:
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.convs += convs
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def child(self, turn: bytes, size: int) -> _Open:
        return _Open(hashlib.sha256(self.key + turn).digest()[:WIDTH], size)

    def close(self, depth: int, parent: _Open | None) -> dict:
        """The row of a complete node, which its parent sums up; only the parent's id is not known yet."""
        saved, leaves = self.saved + (self.convs - 1) * self.size, self.leaves if self.children else 1
        if parent is not None:
            parent.take(self.least, self.convs, 1, leaves, saved)
        for child in self.waiting:
            child["parent_conv_id"] = self.least
        return {"key": self.key, "conv_id": self.least, "depth": depth, "n_convs": self.convs, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved}


def shared_turns(a: bytes, b: bytes) -> int:
    """The LCP of two paths."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def _turns(path: bytes, start: int = 0) -> list[bytes]:
    return [path[k : k + WIDTH] for k in range(start * WIDTH, len(path), WIDTH)]


class _Range:
    """The sweep of one sorted range."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.path = b""
        self.first: tuple[bytes, int] | None = None
        self.first_open: list[list] = []
        self.on_first = 0  # nodes up to this depth are on the first path
        self.out: list[dict] = []

    def pieces(self, node: _Open) -> None:
        if node.ids:
            self.out.append({"kind": "ids", "key": node.key, "first": node.ids[0], "ids": ",".join(map(str, node.ids))})
            node.ids = []

    def pop(self) -> None:
        node = self.stack.pop()
        depth = len(self.stack)
        if depth <= self.on_first:
            self.on_first = depth - 1
            self.pieces(node)
            self.first_open.append(node.numbers())
            return
        parent = self.stack[-1]
        row = node.close(depth, parent) | {"kind": "node", "ends_sha256": hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest()}
        self.out += node.waiting
        if depth - 1 <= self.on_first:
            self.out.append(row | {"parent": parent.key})
        else:
            parent.waiting.append(row)

    def add(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        if self.first is None:
            self.first, self.on_first, shared = (path, conv_id), len(path) // WIDTH, 0
            self.stack.append(_Open(ROOT))
        else:
            shared = shared_turns(self.path, path)
            while len(self.stack) > shared + 1:
                self.pop()
        for turn, size in zip(_turns(path, shared), sizes[shared:], strict=True):
            self.stack.append(self.stack[-1].child(turn, size))
        end = self.stack[-1]
        end.take(conv_id, 1, 0, 0, 0)
        end.ids.append(conv_id)
        if len(self.stack) - 1 <= self.on_first and len(end.ids) >= PIECE_IDS:
            self.pieces(end)
        self.path = path

    def finish(self) -> None:
        if self.first is None:
            return
        for node in self.stack:
            self.out += [child | {"parent": node.key} for child in node.waiting]
            self.pieces(node)
        self.out.append(
            {"kind": "edge", "path": self.first[0], "first": self.first[1], "last_path": self.path, "first_open": self.first_open, "last_open": [node.numbers() for node in self.stack]}
        )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    swept = _Range()
    for batch in batches:
        for conv_id, path, sizes in zip(batch["conv_id"].to_pylist(), batch["path"].to_pylist(), batch["sizes"].to_pylist(), strict=True):
            swept.add(conv_id, path, sizes)
            if len(swept.out) >= 4096:
                yield pa.RecordBatch.from_pylist(swept.out, schema=_SWEPT)
                swept.out = []
    swept.finish()
    if swept.out:
        yield pa.RecordBatch.from_pylist(swept.out, schema=_SWEPT)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes of all ranges, from the ranges' edges in order."""
    stack: list[_Open] = []
    out: list[dict] = []
    last = b""

    def pop() -> None:
        node = stack.pop()
        row = node.close(len(stack), stack[-1] if stack else None)
        out.extend(node.waiting)
        (stack[-1].waiting if stack else out).append(row)

    for batch in batches:
        for edge in batch.to_pylist():
            first, numbers = edge["path"], edge["last_open"][: len(edge["path"]) // WIDTH + 1 - len(edge["first_open"])] + edge["first_open"][::-1]
            if not stack:
                stack.append(_Open(ROOT))
            shared = shared_turns(last, first)
            while len(stack) > shared + 1:
                pop()
            for turn, (size, *_) in zip(_turns(first, shared), numbers[shared + 1 :], strict=True):
                stack.append(stack[-1].child(turn, size))
            for node, (_, *counts) in zip(stack, numbers, strict=True):
                node.take(*counts)
            for _ in edge["first_open"]:
                pop()
            last = edge["last_path"]
            depth = len(stack) - 1
            for turn, (size, *counts) in zip(_turns(last, depth), edge["last_open"][depth + 1 :], strict=True):
                stack.append(stack[-1].child(turn, size))
                stack[-1].take(*counts)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_NODE)
                out.clear()
    while stack:
        pop()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_NODE)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's pieces, which come in order; nothing but the state of one digest is held."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for new, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if new == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = new, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["end_key", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["end_key", "ends"])


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, and ``t``: a struct of conv_id, number, hash (hexadecimal) and bytes of text of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    conv_id = F.col("conv_id").cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull())
    return turns.select(conv_id.alias("conv_id"), F.struct(conv_id.alias("conv_id"), F.col("turn").alias("turn"), digest.alias("hash"), F.octet_length(text).cast("long").alias("size")).alias("t"))


def _as_path(turns: Column) -> tuple[Column, Column]:
    return F.unhex(F.array_join(F.transform(turns, lambda t: t["hash"]), "")).alias("path"), F.transform(turns, lambda t: t["size"]).alias("sizes")


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, path and bytes of each turn's text of the conversations as they are."""
    return turn_rows(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", *_as_path(F.col("turns")))


def rebuilt_sequences(conversations: DataFrame, block: int = 5, longest: int = 9) -> DataFrame:
    """Each conversation c with its first h = crc32(c) % ``longest`` turns from conversation c - c % ``block``: one shuffle, by that id."""
    c = F.col("conv_id")
    base = (c - c % block).alias("base")
    blocks = turn_rows(conversations).groupBy(base).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def of(conv_id: Column) -> Column:
        return F.filter("turns", lambda t: t["conv_id"] == conv_id)

    def rebuild(conv_id: Column) -> Column:
        h = (F.crc32(conv_id.cast("string")) % longest).cast("int")
        own = of(conv_id)
        return F.struct(conv_id.alias("conv_id"), F.concat(F.slice(of(F.col("base")), 1, h), F.slice(own, h + 1, F.greatest(F.size(own), F.lit(1)))).alias("turns"))

    ids = F.array_distinct(F.transform("turns", lambda t: t["conv_id"]))
    return blocks.select(F.inline(F.transform(ids, rebuild))).select("conv_id", *_as_path(F.col("turns")))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths`` (``sequences`` or ``rebuilt_sequences``), from the textless root on.

    conv_id is the least member, parent_conv_id the parent's (null for the root), n_convs the members, n_children and n_leaves (of the
    subtree) count nodes, saved_tokens sums (n_convs - 1) times the bytes of the last text over the subtree, ends_sha256
    is of the ids, ascending and joined by commas, of conversations that end at the node.
    """
    spark = paths.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "trie")
    stored = scratch.write(paths, "paths")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // RANGE_ROWS))
    in_order = stored.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    swept = scratch.write(in_order.mapInArrow(_sweep, from_arrow_schema(_SWEPT)), "swept", partition_by=["kind"])
    edges = swept.where("kind = 'edge'").select("path", "first", "last_path", "first_open", "last_open").repartition(1).sortWithinPartitions("path", "first")
    opened = scratch.write(edges.mapInArrow(_stitch, from_arrow_schema(_NODE)), "open")
    ids = swept.where("kind = 'ids'").select("key", "first", "ids").repartition("key").sortWithinPartitions("key", "first")
    ends = ids.mapInArrow(_hash_pieces, "end_key binary, ends string")
    nodes = swept.where("kind = 'node'")
    salted = opened.select(F.col("key").alias("open_key"), F.col("conv_id").alias("open_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("open_salt"))
    below = nodes.where("parent is not null").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    below = below.join(salted, (F.col("parent") == F.col("open_key")) & (F.col("salt") == F.col("open_salt"))).withColumn("parent_conv_id", F.col("open_id"))
    on_edges = opened.join(ends, F.col("key") == F.col("end_key"), "left").withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)))
    return nodes.where("parent is null").select(*RESULT).unionByName(below.select(*RESULT)).unionByName(on_edges.select(*RESULT))
