"""Conversations as prefix trees of tokens.

Conversations in the order of their turns' hashes lie in depth-first order of the
tree of shared first turns.  Each task walks its range and fills packs: a turn that a
conversation shares with the one before is emitted once, with position ids that go on
from its parent, and each node lists the intervals of its ancestors' tokens, all that it
may attend to besides itself.  A pack is bounded in tokens and conversations; one that
begins within a tree repeats the ancestors, so that a first turn shared by a third of
all conversations is split over tasks (equal conversations by their id).

Template: ``<s>[INST] user [/INST]``, `` assistant </s>``, ``<<SYS>> system <</SYS>>``, and
``<<ROLE>> role <</ROLE>> text <</TURN>>`` for other roles.  In texts a backslash is doubled and each
control string gets one after its first character, so that texts never hold control strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.storage import bound_batches

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<SYS>> (?P<system>.*?) <</SYS>>|<<ROLE>> (?P<role>.*?) <</ROLE>> (?P<text>.*?) <</TURN>>", re.DOTALL
)
PACK_TOKENS, PACK_CONVERSATIONS = 1 << 16, 2048


def escape(text: str) -> str:
    """Reversible; the result holds no control string."""
    text = text.replace("\\", "\\\\")
    while _CONTROL.search(text):  # an overlapping one may be left by the first pass
        text = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def pieces(role: str, text: str) -> tuple[str, str, str]:
    """Opening, text and closing of a turn; the text of an assistant bears the loss."""
    body = escape(text)
    if role == "user":
        return "<s>[INST] ", body, " [/INST]"
    if role == "assistant":
        return " ", body, " </s>"
    if role == "system":
        return "<<SYS>> ", body, " <</SYS>>"
    return f"<<ROLE>> {escape(role)} <</ROLE>> ", body, " <</TURN>>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = next(k for k in ("user", "assistant", "system", "text") if m[k] is not None)
        out.append((unescape(m["role"]) if kind == "text" else kind, unescape(m[kind])))
        at = m.end()
    return out


class _Pack:
    def __init__(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.loss: list[np.ndarray] = []
        self.nodes: list[dict] = []
        self.conversations: list[dict] = []
        self.size = 0

    def add(self, parent: int, parts: list[np.ndarray], loss: bool) -> int:
        n = sum(map(len, parts))
        above = self.nodes[parent] if parent >= 0 else None
        begins = above["position"] + above["end"] - above["start"] if above else 0
        ancestors = [] if above is None else [*above["ancestors"], {"start": above["start"], "end": above["end"]}]
        if len(ancestors) > 1 and ancestors[-2]["end"] == ancestors[-1]["start"]:
            ancestors[-2:] = [{"start": ancestors[-2]["start"], "end": ancestors[-1]["end"]}]
        self.nodes.append({"start": self.size, "end": self.size + n, "parent": parent, "position": begins, "ancestors": ancestors})
        self.tokens += parts
        self.positions.append(np.arange(begins, begins + n, dtype=np.int32))
        self.loss += [np.full(len(p), loss and k == 1) for k, p in enumerate(parts)]
        self.size += n
        return len(self.nodes) - 1


_INTERVAL = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("ancestors", pa.list_(_INTERVAL))])
_MEMBER = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
PACKS = (
    "tokens array<int>, position_ids array<int>, loss_mask array<boolean>,"
    " nodes array<struct<start: int, end: int, parent: int, position: int, ancestors: array<struct<start: int, end: int>>>>, conversations array<struct<conv_id: long, node: int>>"
)


def pack_trees(conversations: DataFrame, tokenizer: str, pack_tokens: int = PACK_TOKENS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """Packs of (conv_id, turn, role, text) rows.

    Turns are ordered by turn (null first), then role and text; null roles and texts are
    empty; repeated rows are turns of their own; a row without a conv_id is a conversation of one turn.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turn = F.struct("turn", "role", "text")
    turns = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = turns.unionByName(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    keyed = turns.withColumn("path", F.concat_ws("", F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0"))))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wayfare.llm.tokens import encoder

        encode = encoder(tokenizer, specials=False).encode
        pack, before, path = _Pack(), [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([np.concatenate(pack.tokens).astype(np.int32) if pack.tokens else []], pa.list_(pa.int32())),
                    pa.array([np.concatenate(pack.positions) if pack.positions else []], pa.list_(pa.int32())),
                    pa.array([np.concatenate(pack.loss) if pack.loss else []], pa.list_(pa.bool_())),
                    pa.array([pack.nodes], pa.list_(_NODE)),
                    pa.array([pack.conversations], pa.list_(_MEMBER)),
                ],
                names=["tokens", "position_ids", "loss_mask", "nodes", "conversations"],
            )

        for batch in batches:
            for conv, turns in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                now = [(t["role"], t["text"]) for t in turns]
                if pack.size >= pack_tokens or len(pack.conversations) >= pack_conversations:
                    yield flush()
                    pack, before, path = _Pack(), [], []
                same = 0
                while same < min(len(before), len(now)) and before[same] == now[same]:
                    same += 1
                path = path[:same]
                for role, text in now[same:]:
                    parts = [encode(p) for p in pieces(role, text)]
                    path.append(pack.add(path[-1] if path else -1, parts, role == "assistant"))
                before = now
                pack.conversations.append({"conv_id": conv, "node": path[-1]})
        if pack.conversations:
            yield flush()

    return ordered.mapInArrow(run, PACKS)


def read_back(packs: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from the packs' tokens alone: n_turns, digests of turns and loss texts, characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wayfare.llm.tokens import encoder

        decode = encoder(tokenizer, specials=False).decode
        for batch in batches:
            out: list[tuple] = []
            for k in range(len(batch)):
                tokens = batch["tokens"][k].values.to_numpy()
                loss = batch["loss_mask"][k].values.to_numpy(zero_copy_only=False)
                nodes = batch["nodes"][k].as_py()
                known: dict[int, tuple] = {}
                for member in batch["conversations"][k].as_py():
                    node = member["node"]
                    if node not in known:
                        spans = [*nodes[node]["ancestors"], nodes[node]]
                        places = np.concatenate([np.arange(s["start"], s["end"]) for s in spans])
                        formatted = decode(tokens[places].tolist())
                        turns = parse(formatted)
                        borne = loss[places]
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], borne, [False]]).astype(np.int8)))
                        said = "".join(unescape(decode(tokens[places[a:b]].tolist())) for a, b in zip(edge[::2], edge[1::2], strict=True))
                        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                        known[node] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted))
                    out.append((member["conv_id"], *known[node]))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return packs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
