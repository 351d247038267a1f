"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification.

``fingerprints``/``link_components`` give the exact answer for 64-bit fingerprints
within two bits.  Four blocks of 16 bits: two close fingerprints agree on at
least two whole blocks, so six keys of 32 bits find every pair.  A block with few
distinct fingerprints is joined with itself and verified by Hamming distance.  A
crowded block would make pairs quadratically; there, each fingerprint is listed
under itself and every one-bit neighbour within the other 32 bits: two
fingerprints are within two bits exactly if they share such a centre, and each is
linked to the least one at the centre, which keeps the components and makes at
most 33 rows a fingerprint.

``near_duplicates`` is the wide form for dedup at a similarity of 0.8 on five-word
shingles (see its docstring).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.arrays import Words, chunks, texts_of
from wayfare.llm.components import connected_components
from wayfare.llm.storage import Scratch, bound_batches

CROWDED = 64
PAIRS = list(combinations(range(4), 2))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text: majority of the XXH64 bits of its shingles; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row: fp as a signed long.  Null and empty texts have fp 0."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in texts_of(batch["text"])], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _block(i: int) -> F.Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def close_links(nodes: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between nodes (node, fp; fp distinct) at two bits or fewer; the closure of all such links is kept."""
    keys = [F.struct(F.lit(k).alias("k"), F.shiftleft(_block(i), 16).bitwiseOR(_block(j)).alias("key")) for k, (i, j) in enumerate(PAIRS)]
    keyed = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("x")).select("node", "fp", "x.k", "x.key")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(keyed.join(sizes, ["k", "key"]), "blocks")
    few = shared.where(F.col("n") <= crowded)
    left, right = (few.select("k", "key", F.col("node").alias(s), F.col("fp").alias(f"{s}_fp")) for s in ("a", "b"))
    pairs = left.join(right, ["k", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= 2)).select("a", "b")
    other = F.element_at(F.array(*[F.array(*[F.lit(b) for b in range(64) if b // 16 not in pair]) for pair in PAIRS]), F.col("k") + 1)
    many = shared.where(F.col("n") > crowded).select("k", "node", "fp", other.alias("bits"))
    listed = many.select("k", "node", F.explode(F.expr("concat(array(fp), transform(bits, b -> fp ^ shiftleft(1L, b)))")).alias("centre"))
    least = listed.groupBy("k", "centre").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = listed.join(least, ["k", "centre"]).where("node <> b").select(F.col("node").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def least_ids(nodes: DataFrame, links: DataFrame, scratch: Scratch, tie: str = "node") -> DataFrame:
    """``nodes`` (node, least_id, ...) with component_id, the least least_id that the links reach (null if none has one), and
    leads: whether this node has it (of several the one with the least ``tie``).

    Nodes have numbers of their own, so that rows whose doc_id is null, or several texts of one doc_id, carry links like any other.
    """
    found = connected_components(links, scratch)
    rooted = nodes.join(found, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    order = F.struct(F.col("least_id").isNull(), "least_id", tie, "node")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min_by("node", order).alias("first"))
    return rooted.join(least, "root").withColumn("leads", F.col("node") == F.col("first")).drop("root", "first")


def link_components(docs: DataFrame, width: int = 3, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row.

    component_id is the least doc_id reachable over fingerprints that differ in two
    bits or fewer, the row's own included.  Rows with null or blank text have
    fingerprint zero and are linked like any other; repeated rows are kept; rows
    whose doc_id is null link like any other but are no minimum (a component of only such rows has a null id).
    Texts of any length are read whole; an empty table gives no row; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, width), "fingerprints")
    # a class of equal fingerprints is a node; its number is the fingerprint
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")).withColumn("node", F.col("fp")), "nodes")
    classes = least_ids(nodes, close_links(nodes, scratch, crowded), scratch).select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- wide form -------------------------------------------------------------------

BLOCKS, BLOCK_BITS = 64, 24
#: The first bits, whose distance is compared.
BITS = 480
RADIUS = 80
#: Five-word Jaccard of a near copy.
LEAST = 0.8
SALTS = 16
#: Blocks whose members are compared with one member each before any pairs are made.
FIRST = 8


def wide_fingerprints(texts: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
    """SimHash of ``BLOCKS`` times ``BLOCK_BITS`` bits over the distinct word pairs, one row of bytes for each text (no words: zero), and the
    sorted 32-bit hashes of its distinct five-word shingles."""
    wide = BLOCKS * BLOCK_BITS
    out = np.zeros((len(texts), wide // 8), dtype=np.uint8)
    sizes, values = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
    for first, last in chunks(texts, 1 << 17):
        words = Words(texts[first:last])
        hashes, doc = _distinct(*words.shingles(5), 32)
        sizes.append(np.bincount(doc, minlength=last - first))
        values.append(hashes.astype(np.uint32).view(np.int32))
        hashes, doc = _distinct(*words.shingles(2), 44)
        starts = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
        if not len(starts):
            continue
        # bits are counted in bytes, eight counters to a word, over runs of 255 hashes at most
        counts = np.diff(np.append(starts, len(doc)))
        runs = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)])
        first_runs = np.searchsorted(runs, starts)
        total = np.zeros((len(starts), wide), dtype=np.uint32)
        for lane in range(wide // 64):
            bits = np.unpackbits(_spread(hashes, lane).view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
            part = np.add.reduceat(bits, runs, axis=0).view(np.uint8)
            total[:, 64 * lane : 64 * lane + 64] = part if len(runs) == len(starts) else np.add.reduceat(part.astype(np.uint32), first_runs, axis=0)
        out[first + doc[starts]] = np.packbits(total * 2 > counts[:, None], axis=1)
    return out, pa.ListArray.from_arrays(np.cumsum(np.concatenate(sizes)).astype(np.int32), pa.array(np.concatenate(values)))


def block_keys(prints: np.ndarray) -> np.ndarray:
    """The blocks of each fingerprint: number of the block in the upper bits, its ``BLOCK_BITS`` below."""
    parts = prints.reshape(len(prints), BLOCKS, BLOCK_BITS // 8).astype(np.int32)
    return (np.arange(BLOCKS, dtype=np.int32) << 24) | (parts[:, :, 0] << 16) | (parts[:, :, 1] << 8) | parts[:, :, 2]


def _distinct(hashes: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest ``bits`` of the hashes, sorted and each once a document; ``doc`` is below 2^(64 - bits)."""
    both = np.unique(doc.astype(np.uint64) << np.uint64(bits) | hashes >> np.uint64(64 - bits))
    return both & np.uint64((1 << bits) - 1), (both >> np.uint64(bits)).astype(np.int64)


def _spread(hashes: np.ndarray, lane: int) -> np.ndarray:
    from wayfare.llm.arrays import mix

    return mix(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, crowded: int = 16, cell: int = 512, least: float = LEAST) -> DataFrame:
    """doc_id, text_key, text_hash, component_id, keep for every row: near copies at ``least`` on five-word shingles.

    A copy at a five-word Jaccard of 0.8 differs in one word of 45, so its word
    pairs have a cosine of 0.956 and a SimHash over pairs differs in about a tenth of its
    bits: far more than any pigeonhole over 64 bits can promise.  64 blocks of 24 bits
    always catch pairs within 63 of 1536 bits and catch 99 % at a Jaccard of 0.8.  ``radius``, over the first
    480 bits, only takes chance meetings (some 240 bits) out; a link is a pair whose sets of
    five-word shingles have a Jaccard of ``least`` or more, computed from the sets.
    Equal texts (after white space and A-Z folding) are one class beforehand.

    In the first 8 blocks each member is compared with the block's least member, which joins most of a large group.  Then,
    in all blocks, only members that the links so far leave in different components are compared: in blocks of up to
    ``crowded`` classes pairwise, in larger ones each with the block's least member and then, if still apart, with all
    others in cells of ``cell`` members by ``cell``.  The components are those of all pairs.
    Kept are the rows with the least doc_id of each component, where that is null one class of equal texts.
    Null and blank texts are one class.  Rows with a null doc_id link like any other; several texts of one doc_id are compared each on its own.
    Equal rows are one class; of rows with equal doc_id and text all are marked.  Texts of any length are read whole; an empty table gives no row.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "near")

    def lists(values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch["text"])
            prints, sets = wide_fingerprints(texts)
            longs = np.zeros((len(texts), 64), dtype=np.uint8)
            longs[:, : BITS // 8] = prints[:, : BITS // 8]
            keys = [text_key(t) for t in texts]
            names = ["doc_id", "text_key", "text_hash", "fp", "blocks", "shingles"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys, pa.string()), batch["text_hash"], lists(longs.view("<i8")), lists(block_keys(prints)), sets], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = scratch.write(given.mapInArrow(run, "doc_id long, text_key string, text_hash long, fp array<long>, blocks array<int>, shingles array<int>"), "fingerprints")
    texts = rows.withColumn("n", F.size("shingles")).groupBy("text_key").agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("fp", "blocks", "n")])
    # numbered as written: a number of its own for each class of equal texts
    nodes = scratch.write(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    classes = least_ids(nodes.select("node", "text_key", "least_id"), _near_links(nodes, rows, scratch, radius, crowded, cell, least), scratch, "text_key")
    marked = rows.select("doc_id", "text_key", "text_hash").join(classes, "text_key")
    return marked.select("doc_id", "text_key", "text_hash", "component_id", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("least_id"))).alias("keep"))


def text_key(text: bytes) -> str:
    """Of equal texts after white space and A-Z folding."""
    return xxhash.xxh3_128_hexdigest(b" ".join(text.lower().split()))


def _alike(common: F.Column, a: str, b: str, least: float) -> F.Column:
    return common / (F.col(a) + F.col(b) - common) >= least


def _near_links(nodes: DataFrame, rows: DataFrame, scratch: Scratch, radius: int, crowded: int, cell: int, least: float) -> DataFrame:
    """Links (a, b) between nodes (node, text_key, least_id, fp, blocks, n) whose components are those of all near pairs that share a block.

    ``rows`` has the n shingles of each doc_id (a least_id) and text_key.
    """
    keyed = nodes.select("node", F.explode("blocks").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = scratch.write(keyed.join(sizes, "key"), "blocks")
    # fingerprint and set of all that share a block with another, in buckets by node: pairs come to them
    asked = nodes.select("node", F.col("text_key").alias("asked_key"), "least_id", "fp", "n").join(members.select("node").distinct(), "node")
    same = (F.col("text_key") == F.col("asked_key")) & F.col("doc_id").eqNullSafe(F.col("least_id"))
    facts = rows.select("doc_id", "text_key", "shingles").join(asked, same).groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "n", "shingles")])
    facts = scratch.write_sorted(facts, "facts", "node", [], max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # a crowded block's members are not all in one task
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")

    def compared(blocks: DataFrame, pairwise: bool, label: str) -> DataFrame:
        """Links of blocks (key, n, pivot, node, part): of all members of different parts if ``pairwise`` and the block is not crowded, else of each
        member and the pivot."""
        small = (F.col("n") <= crowded) if pairwise else F.lit(False)
        columns = ["key", "n", "pivot", "node", "part"]
        others = blocks.where((F.col("node") != F.col("pivot")) | small).select(*columns, F.when(small, 0).otherwise(salt).alias("salt"))
        rows = others.unionByName(blocks.where((F.col("node") == F.col("pivot")) & ~small).select(*columns, salted))
        held = rows.join(facts.select("node", "fp", F.col("n").alias("size")), "node").select("key", "salt", "node", "part", "fp", "size", small.alias("small"))
        dealt = held.repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
        near = scratch.write(dealt.mapInArrow(_near_in_blocks(radius, least), "a long, b long, n_a int, n_b int").distinct(), "near")
        sa, sb = (facts.select(F.col("node").alias(s), F.col("shingles").alias(f"s_{s}")) for s in ("a", "b"))
        return scratch.write(near.join(sa, "a").join(sb, "b").where(_alike(F.size(F.array_intersect("s_a", "s_b")), "n_a", "n_b", least)).select("a", "b"), label)

    links = compared(members.where(F.shiftright("key", 24) < FIRST).withColumn("part", F.col("node")), False, "early")

    def parts(blocks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """key, n, pivot, node, part (its component) of the blocks; and the links as one for each node."""
        known = connected_components(links, scratch)
        told = blocks.join(known, "node", "left").select("key", "n", "pivot", "node", F.coalesce("component", "node").alias("part"))
        return told, known.select(F.col("component").alias("a"), F.col("node").alias("b"))

    told, links = parts(members, links)
    mixed = told.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    told = scratch.write(told.join(mixed, "key", "left_semi"), "parts")
    many = told.where(F.col("n") > crowded)
    links = links.unionByName(compared(told, True, "pairs"))
    if many.isEmpty():
        return links
    told, links = parts(many.select("key", "n", "pivot", "node"), links)
    told = scratch.write(told, "parts")
    heads = told.where("node = pivot").select("key", F.col("part").alias("head"), salted)
    apart = told.select("key", "node", "part", salt).join(heads, ["key", "salt"]).select("key", "salt", "node", "part", (F.col("part") != F.col("head")).alias("other"))
    counts = apart.groupBy("key").agg(F.count_if("other").alias("others"), F.count_if(~F.col("other")).alias("rest")).where("others > 0").select("*", salted)
    return links.unionByName(scratch.write(_cell_links(apart.join(counts, ["key", "salt"]).join(facts.select("node", "fp", "shingles"), "node"), radius, cell, least), "cells"))


def _near_in_blocks(radius: int, least: float):
    """For rows (key, salt, node, part, fp, size, small) by key and salt: pairs of different parts within the radius whose set sizes allow ``least``, of all
    rows of a small block, else of each row with the first.  No more than one small block, or the first row of another, is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            prints = batch["fp"].flatten().to_numpy().view(np.uint64).reshape(len(batch), -1)
            columns = [batch[c].to_pylist() for c in ("key", "salt", "node", "part", "size", "small")]
            for k, (key, salt, node, part, size, small) in enumerate(zip(*columns, strict=True)):
                if group != (key, salt):
                    group, held = (key, salt), []
                for other, other_part, other_size, other_print in held:
                    if other_part != part and min(size, other_size) >= least * max(size, other_size) - 1e-6 and int(np.bitwise_count(other_print ^ prints[k]).sum()) <= radius:
                        out.append((other, node, other_size, size) if other < node else (node, other, size, other_size))
                if small or not held:
                    held.append((node, part, size, prints[k].copy()))
            if out:
                a, b, n_a, n_b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32())], names=["a", "b", "n_a", "n_b"])

    return run


def _cell_links(apart: DataFrame, radius: int, cell: int, least: float) -> DataFrame:
    """Links between members of different parts of a block.

    ``other`` marks members outside the part of the block's pivot.  These are dealt into cells with the rest (x from 0) and
    with one another (x below 0); members of one part need no comparison.
    """
    sized = apart.withColumns({n: F.ceil(F.col(c) / cell).cast("int") for n, c in (("o", "others"), ("r", "rest"))})
    own = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("o")).otherwise(F.col("r"))).cast("int"))
    across = "transform(sequence(0, r - 1), i -> struct(i as x, own as y))"
    among = "transform(sequence(0, o - 1), i -> struct(-1 - least(own, i) as x, greatest(own, i) as y))"
    dealt = own.withColumn("c", F.explode(F.expr(f"if(other, concat({across}, {among}), transform(sequence(0, o - 1), i -> struct(own as x, i as y)))")))
    cells = dealt.select("key", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "node", "part", "other", "fp", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        node, part, other = (table[c].to_numpy() for c in ("node", "part", "other"))
        part = part.copy()
        prints = table["fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        held = table["shingles"].combine_chunks()
        n, held = held.value_lengths().to_numpy(), np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1])
        able = ~other if table["x"][0].as_py() >= 0 else np.ones(len(node), dtype=bool)
        a, b = [], []
        for i in np.flatnonzero(other):
            at = np.flatnonzero(able & (part != part[i]))
            at = at[np.minimum(n[at], n[i]) >= least * np.maximum(n[at], n[i]) - 1e-6]
            distance = np.bitwise_count(prints[at] ^ prints[i]).sum(axis=1, dtype=np.int64)
            for j in at[distance <= radius][np.argsort(distance[distance <= radius], kind="stable")]:
                if part[j] == part[i]:
                    continue
                common = len(np.intersect1d(held[i], held[j], assume_unique=True))
                if common and common / (int(n[i]) + int(n[j]) - common) >= least:
                    a.append(node[i])
                    b.append(node[j])
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near copies, with their columns (whatever their names)."""
    marked = near_duplicates(docs, **options).where("keep")
    kept = marked.groupBy("text_key", "doc_id").agg(F.min("text_hash").alias("__hash"), F.count("*").alias("__n")).select(F.col("doc_id").alias("__id"), "__hash", "__n")
    kept = Scratch(docs.sparkSession, "kept").write(kept, "kept")

    def those(some: DataFrame) -> DataFrame:
        return docs.join(some, docs["doc_id"].cast("long").eqNullSafe(some["__id"]) & (F.xxhash64(docs["text"]) == some["__hash"]), "left_semi")

    repeated = kept.where("__n > 1")  # rows given more than once
    return those(kept) if repeated.isEmpty() else those(kept.where("__n = 1")).unionByName(those(repeated).dropDuplicates(["doc_id", "text"]))
