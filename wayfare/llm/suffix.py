"""Exact removal of repeated 200-byte strings with a logarithmic family of suffix arrays.

A dense suffix array needs four bytes or more for every byte of text, several times
what the input takes on disk.  The arrays here are sparse: a suffix is listed
only where it starts with the least 64-byte gram of some window of ``length`` bytes
(a minimizer, one byte in 69).  Equal windows have their minimizer at the same
place, so every repeated window is found from two listed suffixes that
share a prefix of 64 bytes, and nothing shorter is compared.

* ``anchors``: each listed suffix with its *region*, the bytes of all windows that chose it.
* ``LevelFamily``: a batch's suffixes in order (of prefix, then region, both as hashes: any order that puts equal strings side by side
  serves) are a suffix array, a table in sorted buckets.  A new batch's array is merge-scanned against itself and every level:
  a suffix is a hit as soon as its prefix is met a second time.  Then the array becomes a level of one batch; before the next
  batch, levels of equal size merge, so that n batches leave at most log2(n) + 1 levels and each batch is rewritten log2(n) times.
  No earlier text is read again to add a batch.  A prefix that much of a batch has is spread over all buckets.
* ``spans``: if a hit's whole region occurs twice, all of its windows do.  Otherwise the
  region is *open*, and the windows of all different regions at that prefix are sorted
  (a dense suffix array of this prefix alone) and equal neighbours are matches.

Prefixes with more than ``crowded`` different regions are not gathered: their windows
are sorted by hash over the cluster instead.  Prefixes and regions are compared by
64 and 128 bits of hash, windows of gathered regions byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.arrays import U64, mix, texts_of
from wayfare.llm.storage import Scratch, bound_batches

LENGTH = 200
GRAM = 64
CROWDED = 256
PIECE = 1 << 20
#: Hot prefixes of a batch at most, and prefixes that the sketch follows to find them.
HOT, TRACKED = 1000, 10000
_MIXED = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place (gram a power of two)."""
    h = _MIXED[data]
    step = 1
    with np.errstate(over="ignore"):
        while step < gram:
            h = (h[:-step] * U64(0xC2B2AE3D27D4EB4F)) ^ (h[step:] + (h[:-step] >> U64(29)))
            h ^= h >> U64(32)
            step *= 2
    return mix(h)


def _regions(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, place of the minimizer, its hash) for every run of windows with one minimizer."""
    n = len(text)
    span = length - gram + 1
    for base in range(0, n - length + 1, PIECE):
        data = np.frombuffer(text, dtype=np.uint8, count=min(n - base, PIECE + length - 1), offset=base)
        h = _gram_hashes(data, gram)
        place = np.arange(len(h), dtype=np.uint64)
        low = U64((1 << 21) - 1)
        least = (h & ~low) | place
        step = 1
        while step * 2 <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        chosen = (least & low).astype(np.int64)
        first = np.flatnonzero(np.diff(np.concatenate([[-1], chosen])))
        last = np.append(first[1:], len(chosen)) - 1
        at = chosen[first]
        yield first + base, last + base, at + base, h[at]


ENTRY = "doc_id long, text_hash long, a int, b int, p int, key long, rh1 long, rh2 long"
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
#: Stands for a null doc_id in the tables in between; the windows of a text depend on the text alone, so that any row with that id and text may have them.
NULL = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the id and the text hash that the suffixes carry."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, a, b (first and last window of the region), p (place), key (prefix), rh1, rh2 (region) of every listed suffix."""
    bound_batches(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in incoming:
            parts: list[list[np.ndarray]] = [[] for _ in COLUMNS]
            for doc, whole, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), texts_of(batch["text"]), strict=True):
                if len(text) < length:
                    continue
                for a, b, p, h in _regions(text, length, gram):
                    rh = np.frombuffer(b"".join([digest(text[x:y]) for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
                    same = np.ones(len(a), dtype=np.int64)
                    for at, values in enumerate((same * doc, same * whole, a, b, p, h.view(np.int64), rh[:, 0], rh[:, 1])):
                        parts[at].append(values)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], names=COLUMNS)

    return _keyed(docs).where(F.octet_length("text") >= length).mapInArrow(run, ENTRY)


class LevelFamily:
    """Levels of sorted suffixes.  ``add`` a batch and it is scanned against all before; ``hits`` are the suffixes whose prefix was met twice, each once.

    A prefix with over a quarter of a bucket's mean share (and ``least_hot`` suffixes) is *hot*: its suffixes lie in all buckets, by a salt.
    Being met twice in its own batch, it needs no scan: any suffix with a prefix that is hot in the batch or in a level is a hit.
    """

    def __init__(self, scratch: Scratch, buckets: int | None = None, least_hot: int = 256):
        self.scratch = scratch
        self.buckets = buckets or max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
        self.least_hot = max(least_hot, 1)
        #: Batches, table, hot prefixes of each level.
        self.levels: list[tuple[int, DataFrame, frozenset[int]]] = []
        self.found: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """One batch of anchors."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, new, some), (_, old, others) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._sorted(old.unionByName(new), some | others), some | others))
            self.scratch.drop(old)
            self.scratch.drop(new)
            self.scratch.free_shuffles()
        batch = self.scratch.write(suffixes.select(*COLUMNS), "batch")
        own = self._hot(batch)
        array = self._sorted(batch, own)
        self.scratch.drop(batch)
        self.scratch.free_shuffles()
        hot = F.col("key").isin(sorted(own.union(*[x for _, _, x in self.levels])))
        met = self._met(array, hot)
        rest = array.where(~hot)
        again = rest.groupBy("key", "salt").agg(F.count("*").alias("n")).where("n > 1").select("key", "salt")
        # a suffix alone with its prefix so far is a hit now; two and more were hits before
        known = again if met is None else again.unionByName(met.select("key", "salt")).distinct()
        hits = rest.join(known.hint("merge"), ["key", "salt"], "left_semi").select(*COLUMNS).unionByName(array.where(hot).select(*COLUMNS))
        if met is not None:
            hits = hits.unionByName(met.where("n = 1").select(*COLUMNS))
        self.found.append(self.scratch.write(hits, "hits"))
        if met is not None:
            self.scratch.drop(met)
        self.levels.append((1, array, own))

    def _hot(self, batch: DataFrame) -> frozenset[int]:
        """Hot prefixes of a batch: candidates from a sketch of bounded size, counted exactly."""
        row = batch.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(key, {HOT}, {TRACKED})").alias("top")).first()
        most = max(row["n"] // (4 * self.buckets), self.least_hot)
        often = [x["item"] for x in row["top"] or [] if x["count"] > most]
        if not often:
            return frozenset()
        return frozenset(x["key"] for x in batch.where(F.col("key").isin(often)).groupBy("key").count().where(F.col("count") > most).collect())

    def _sorted(self, suffixes: DataFrame, hot: frozenset[int]) -> DataFrame:
        salt = F.when(F.col("key").isin(sorted(hot)), 1 + F.pmod(F.xxhash64("doc_id", "text_hash", "p"), F.lit(self.buckets))).otherwise(0).cast("int").alias("salt")
        return self.scratch.write_sorted(suffixes.select(*COLUMNS, salt), "array", ["key", "salt"], ["rh1", "rh2"], self.buckets)

    def _met(self, array: DataFrame, hot: Column) -> DataFrame | None:
        """key, salt, n, and one suffix of each prefix of the array in the levels: each level is read along with the array, bucket by bucket; of
        hot prefixes, of which there are few, the salts' counts are added."""
        if not self.levels:
            return None
        each = [F.first(c).alias(c) for c in COLUMNS if c != "key"]
        present = F.broadcast(array.where(hot).select("key").distinct())  # HOT a batch at most
        wanted = array.where(~hot).select("key", "salt").hint("merge")
        merged = few = None
        for _, level, _ in self.levels:
            counted = level.where(~hot).join(wanted, ["key", "salt"], "left_semi").groupBy("key", "salt").agg(F.count("*").alias("n"), *each)
            crowd = level.where(hot).join(present, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), *each)
            merged, few = (counted, crowd) if merged is None else (merged.unionByName(counted), few.unionByName(crowd))
        if len(self.levels) > 1:
            merged = merged.groupBy("key", "salt").agg(F.sum("n").alias("n"), *each)
            few = few.groupBy("key").agg(F.sum("n").alias("n"), *each)
        return self.scratch.write(merged.unionByName(few.withColumn("salt", F.lit(0))), "met")

    def hits(self) -> DataFrame:
        out = self.found[0]
        for other in self.found[1:]:
            out = out.unionByName(other)
        return out

    def drop_levels(self) -> None:
        """No batch comes any more."""
        for _, level, _ in self.levels:
            self.scratch.drop(level)
        self.levels = []
        self.scratch.free_shuffles()


def repeated_spans(docs: DataFrame, scratch: Scratch, batches: int = 4, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """doc_id, text_hash, windows (array of first, last) whose windows of ``length`` bytes start elsewhere too.

    The table arrives in ``batches``, by a hash of the text.  Texts shorter than ``length`` have none.  Null ids are listed as the least long.
    """
    family = LevelFamily(scratch)
    for lot in range(batches):
        family.add(anchors(docs.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == lot), length, gram))
    family.drop_levels()
    return spans(docs, family, scratch, length, crowded)


def spans(docs: DataFrame, family: LevelFamily, scratch: Scratch, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """doc_id, text_hash, windows of the texts that were added, ``docs``; the family stays as it is."""
    all_hits = family.hits()
    counts = all_hits.groupBy("key", "rh1", "rh2").agg(F.count("*").cast("int").alias("n"))
    regions = counts.groupBy("key").agg(F.count("*").alias("regions"))
    hits = scratch.write(all_hits.join(counts.join(regions, "key"), ["key", "rh1", "rh2"]), "counted")
    scratch.free_shuffles()
    whole = hits.where("n > 1").select("doc_id", "text_hash", "a", "b")
    # open regions, and one copy of each whole one at their prefix, are compared
    in_question = hits.where("regions > 1")
    copies = in_question.where("n > 1").groupBy("key", "rh1", "rh2").agg(F.min_by(F.struct("doc_id", "text_hash", "a", "b", "p", "regions"), F.struct("doc_id", "text_hash", "a")).alias("x"))
    copies = copies.select("x.doc_id", "x.text_hash", "x.a", "x.b", "x.p", "key", "x.regions", F.lit(True).alias("known"))
    wanted = in_question.where("n = 1").select("doc_id", "text_hash", "a", "b", "p", "key", "regions", F.lit(False).alias("known")).unionByName(copies)
    by_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b", "p", "key", "regions", "known")).alias("regions"))
    texts = scratch.write(_region_texts(docs, by_doc, length), "regions")
    scratch.free_shuffles()
    few = _sorted_windows(texts.where(F.col("regions") <= crowded), length)
    many = _hashed_windows(texts.where(F.col("regions") > crowded), length)
    found = scratch.write(whole.unionByName(few).unionByName(many), "found")
    scratch.drop(texts)
    scratch.drop(hits)
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("windows"))


def _region_texts(docs: DataFrame, by_doc: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted region (of each of several equal rows)."""
    bound_batches(docs.sparkSession)
    joined = _keyed(docs).join(by_doc, ["doc_id", "text_hash"])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "a", "b", "p", "key", "regions", "known", "region"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in incoming:
            rows = []
            for doc, text_hash, text, regions in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), texts_of(batch["text"]), batch["regions"].to_pylist(), strict=True):
                rows += [(doc, text_hash, r["a"], r["b"], r["p"], r["key"], r["regions"], r["known"], text[r["a"] : r["b"] + length]) for r in regions]
            for at in range(0, len(rows), 20000):
                part = list(zip(*rows[at : at + 20000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types, strict=True)], names=names)

    return joined.mapInArrow(run, "doc_id long, text_hash long, a int, b int, p int, key long, regions long, known boolean, region binary")


_FOUND = "doc_id long, text_hash long, a int, b int"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and out[-1][1] == s - 1:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def match_windows(regions: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[int]]:
    """For (place of the prefix in the region, bytes): the windows of each that another one has too.

    Windows with the prefix at one place are sorted together; equal neighbours match.
    """
    found: list[list[int]] = [[] for _ in regions]
    entries = sorted((at - s, region[s : s + length], k, s) for k, (at, region) in enumerate(regions) for s in range(len(region) - length + 1))
    for x, y in zip(entries, entries[1:], strict=False):
        if x[0] == y[0] and x[1] == y[1]:
            found[x[2]].append(x[3])
            found[y[2]].append(y[3])
    return [sorted(set(f)) for f in found]


def _sorted_windows(texts: DataFrame, length: int) -> DataFrame:
    ordered = texts.repartition("key").sortWithinPartitions("key")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def done() -> list[tuple]:
            matched = match_windows([(p - a, region) for _, _, a, _, p, _, _, region in group], length)
            return [(doc, h, a + x, a + y) for (doc, h, a, _, _, _, known, _), starts in zip(group, matched, strict=True) if not known for x, y in _runs(starts)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND_TYPES, strict=True)], names=["doc_id", "text_hash", "a", "b"])

        for batch in incoming:
            rows: list[tuple] = []
            columns = [batch[c].to_pylist() for c in ("doc_id", "text_hash", "a", "b", "p", "key", "known", "region")]
            for row in zip(*columns, strict=True):
                if group and group[0][5] != row[5]:
                    rows += done()
                    group = []
                group.append(row)
            if rows:
                yield out(rows)
        if group and (rows := done()):
            yield out(rows)

    return ordered.select("doc_id", "text_hash", "a", "b", "p", "key", "known", "region").mapInArrow(run, _FOUND)


_WINDOW = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("doc", "<i8"), ("hash", "<i8"), ("s", "<i4"), ("known", "?"), ("twice", "?")])
#: Windows of a lot.
LOT = 1 << 20


def _dealt(lot: np.ndarray, packed: np.ndarray, lots: int) -> Iterator[pa.RecordBatch]:
    """Packed records as one row for each lot that has some."""
    if not len(packed):
        return
    order = np.argsort(lot, kind="stable")
    edges = np.searchsorted(lot[order], np.arange(lots + 1))
    packed = packed[order]
    some = [k for k in range(lots) if edges[k] < edges[k + 1]]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())], names=["lot", "packed"])


def _by_lot(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """All records of each lot; rows come sorted by lot."""
    now, held = None, []
    for batch in batches:
        for lot, packed in zip(batch["lot"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            if lot != now and held:
                yield np.concatenate(held)
                held = []
            now = lot
            held.append(np.frombuffer(packed, dtype=kind))
    if held:
        yield np.concatenate(held)


def _hashed_windows(texts: DataFrame, length: int) -> DataFrame:
    """Windows of crowded prefixes, sorted by hash over the cluster.

    Windows are dealt by their hash to lots of ``LOT`` windows, packed into one binary
    for each task and lot rather than a row each; matches go back by document the same way.  Of a window that a task meets
    often, one goes to the window's lot and the others, matched already, straight to their document's.
    """
    windows = texts.agg(F.sum(F.octet_length("region") - (length - 1))).first()[0] or 0
    lots = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-windows // LOT))
    full = 1 << 17

    def lots_of(values: np.ndarray) -> np.ndarray:
        return (mix(values.view("<u8").copy()) % np.uint64(lots)).astype(np.int64)

    def twice(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of records in order: whether equal to the one before, and whether equal to either neighbour."""
        equal = (records["w1"][1:] == records["w1"][:-1]) & (records["w2"][1:] == records["w2"][:-1])
        after = np.concatenate([[False], equal])
        return after, after | np.concatenate([equal, [False]])

    def deal(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            packed = np.concatenate(held)
            packed = packed[np.lexsort((packed["w2"], packed["w1"]))]
            after, packed["twice"] = twice(packed)
            lot = lots_of(packed["w1"])
            lot[after] = lots_of(packed["hash"][after])
            yield from _dealt(lot, packed, lots)
            held.clear()

        for batch in incoming:
            columns = [batch[c].to_pylist() for c in ("doc_id", "text_hash", "a", "known", "region")]
            for doc, text_hash, a, known, region in zip(*columns, strict=True):
                n = len(region) - length + 1
                hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(region[s : s + length]) for s in range(n)]), dtype="<i8").reshape(-1, 2)
                records = np.zeros(n, _WINDOW)
                records["w1"], records["w2"], records["doc"], records["hash"], records["s"], records["known"] = hashes[:, 0], hashes[:, 1], doc, text_hash, np.arange(a, a + n), known
                held.append(records)
                size += n
                if size >= full:
                    yield from out()
                    size = 0
        yield from out()

    def match(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _by_lot(incoming, _WINDOW):
            records = records[np.lexsort((records["w2"], records["w1"]))]
            _, equal = twice(records)
            found = records[(equal | records["twice"]) & ~records["known"]]
            yield from _dealt(lots_of(found["hash"]), found, lots)

    def collect(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_lot(incoming, _WINDOW):
            found = found[np.lexsort((found["s"], found["hash"], found["doc"]))]
            same = (found["doc"][1:] == found["doc"][:-1]) & (found["hash"][1:] == found["hash"][:-1])
            breaks = np.flatnonzero(~(same & (found["s"][1:] - found["s"][:-1] <= 1)))
            first, last = np.concatenate([[0], breaks + 1]), np.append(breaks, len(found) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c.copy(), t) for c, t in zip((found["doc"][first], found["hash"][first], found["s"][first], found["s"][last]), _FOUND_TYPES, strict=True)], names=["doc_id", "text_hash", "a", "b"])

    lot = "lot int, packed binary"
    dealt = texts.select("doc_id", "text_hash", "a", "known", "region").mapInArrow(deal, lot).repartition(lots, "lot").sortWithinPartitions("lot")
    back = dealt.mapInArrow(match, lot).repartition(lots, "lot").sortWithinPartitions("lot")
    return back.mapInArrow(collect, _FOUND)


def removed_runs(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes [start, end) covered by the windows."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


def remove_repeats(docs: DataFrame, batches: int = 4, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """doc_id, kept (bytes that stay), spans (removed runs), n_bytes for every row.

    A null text is empty; an empty one and one shorter than ``length`` stay as they are.  Equal rows are copies of one another: of a text given twice nothing
    of ``length`` bytes stays.  Rows with a null doc_id are treated like any other.  Texts of any length are read whole; an
    empty table gives no row; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    found = repeated_spans(docs, scratch, batches, length, gram, crowded).select(F.col("doc_id").alias("id"), "text_hash", "windows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(NULL)).cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return _cut(rows.join(found, ["id", "text_hash"], "left"), length)


def _cut(joined: DataFrame, length: int) -> DataFrame:
    bound_batches(joined.sparkSession)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in incoming:
            kept, spans, sizes = [], [], []
            for text, windows in zip(texts_of(batch["text"]), batch["windows"].to_pylist(), strict=True):
                runs = removed_runs([(w["a"], w["b"]) for w in windows or []], length)
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                spans.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(kept, pa.binary()), pa.array(spans, span), pa.array(sizes, pa.int64())], names=["doc_id", "kept", "spans", "n_bytes"])

    return joined.select("doc_id", "text", "windows").mapInArrow(run, "doc_id long, kept binary, spans array<struct<start: long, end: long>>, n_bytes long")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
