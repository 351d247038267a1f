"""Token ids as sorted-string-table shards.

A shard holds documents in key order: blocks of prefix-compressed entries
(compressed, with a checksum), then a sparse index (first key and place of each
block), a Bloom filter of the keys, and a footer.  ``Shard.get`` finds a document by Bloom
filter, binary search of the index, and a scan of one block.

A key is the document's identifier in big-endian order (null first) and the number
of the copy among rows with the same identifier.  A value is the token ids, two bytes each
if the vocabulary allows, else four.  Null and empty texts have only the end id.

Shards are written by the tasks through pyarrow's file systems below the shared
folder, under names that no other attempt uses; the manifest, a table that
Spark commits, lists those of the attempts that counted.
"""

from __future__ import annotations

import bisect
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.arrays import texts_of
from wayfare.llm.storage import Scratch, bound_batches

MAGIC = b"WFSST001"
BLOCK = 1 << 16
SHARD = 64 << 20
FOOTER = struct.Struct("<QQQQQQIB7x8s")


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))
    return head + struct.pack(">I", copy)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


class ShardWriter:
    """Writes entries, given in key order, to a binary stream."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[int] = []
        self.at = self.entries = self.ids = 0
        self._begin()

    def _begin(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.first, self.last = 0, None, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first = key
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"the id {int(ids.max())} does not fit in {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _number(shared) + _number(len(key) - shared) + _number(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(xxhash.xxh3_64_intdigest(key))
        self.entries += 1
        self.ids += len(ids)
        if self.size >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.parts:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.parts))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
        self._begin()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        listed = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QI", a, n) for k, a, n in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(-(-bits // 8), dtype=np.uint8)
        if self.keys:
            hashes = np.array(self.keys, dtype=np.uint64)
            for place in _bloom_places(hashes, bits):
                np.bitwise_or.at(bloom, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        self.out.write(listed + bloom.tobytes())
        self.out.write(FOOTER.pack(index_at, len(listed), index_at + len(listed), bits, self.entries, self.ids, len(self.index), self.width, MAGIC))


def _bloom_places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    for k in range(7):
        yield ((low + np.uint64(k) * high) % np.uint64(bits)).astype(np.int64)


class Shard:
    """Reads a shard from a seekable binary stream."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, io.SEEK_END)
        size = stream.tell()
        footer = self._bytes(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.entries, self.ids, blocks, self.width, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard, or an unfinished one")
        listed, at = self._bytes(index_at, index_size), 0
        self.first, self.places = [], []
        for _ in range(blocks):
            n = listed[at]
            self.first.append(listed[at + 1 : at + 1 + n])
            self.places.append(struct.unpack_from("<QI", listed, at + 1 + n))
            at += 1 + n + 12
        self.bloom = self._bytes(bloom_at, -(-self.bits // 8))

    def _bytes(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._bytes(*self.places[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_number(data, at)
            own, at = _read_number(data, at)
            size, at = _read_number(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, dtype=f"<u{self.width}", count=size // self.width, offset=at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self._block(k)

    def may_have(self, key: bytes) -> bool:
        hashes = np.array([xxhash.xxh3_64_intdigest(key)], dtype=np.uint64)
        return all(self.bloom[int(p[0]) >> 3] >> (int(p[0]) & 7) & 1 for p in _bloom_places(hashes, self.bits))

    def get(self, key: bytes) -> np.ndarray | None:
        """Token ids of a key, or None."""
        k = bisect.bisect_right(self.first, key) - 1
        if k < 0 or not self.may_have(key):
            return None
        return next((ids for found, ids in self._block(k) if found == key), None)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, shard_bytes: int = SHARD) -> DataFrame:
    """Encode and write every row in ascending doc_id order; the manifest: path, first_id, n_docs, n_ids, start, part, shard.

    Ids take two bytes if the tokenizer's vocabulary and ``end_id`` allow, else four.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bound_batches(spark)
    folder = scratch.path("shards")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from wayfare.llm.tokens import encoder

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        made: list[tuple] = []
        writer = stream = path = None
        last: tuple[int | None, int] = (None, -1)
        end = np.array([end_id], dtype="<u4")

        def finish() -> None:
            writer.close()
            stream.close()
            made.append((path, first, writer.entries, writer.ids, part, len(made)))

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                last = (doc, last[1] + 1 if last[1] >= 0 and last[0] == doc else 0)
                if writer is not None and writer.at >= shard_bytes:
                    finish()
                    writer = None
                if writer is None:
                    path, first = f"{root}/part-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.sst", doc
                    stream = store.open_output_stream(path)
                    writer = ShardWriter(stream, width)
                writer.add(key_of(*last), np.concatenate([encode(text.decode()), end]))
        if writer is not None:
            finish()
        if made:
            columns = list(zip(*made, strict=True))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "first_id", "n_docs", "n_ids", "part", "shard"])

    manifest = scratch.write(ordered.mapInArrow(run, "path string, first_id long, n_docs long, n_ids long, part int, shard int"), "manifest")
    # one row for each shard of 64 MB: a window over all of them is small
    order = Window.orderBy(F.asc_nulls_first("first_id"), "part", "shard")
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before).withColumn("folder", F.lit(folder))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """doc_id, copy, start and ids of every document of the listed shards."""
    for batch in batches:
        for folder, path, start in zip(batch["folder"].to_pylist(), batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
            store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
            with store.open_input_file(path) as stream:
                for key, ids in Shard(stream):
                    yield id_of(key), struct.unpack(">I", key[9:])[0], start, ids
                    start += len(ids)


def _in_parts(documents, most: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for document in documents:
        held.append(document)
        size += len(document[3]) + 64
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _listed(manifest: DataFrame) -> DataFrame:
    """A task for each shard."""
    return manifest.select("folder", "path", "start").repartition(max(1, manifest.count()))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, copy, start, ids of every document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_parts(_documents(batches), 1 << 19):
            yield _held([(*r[:3], r[3].astype(np.uint32)) for r in rows])

    return _listed(manifest).mapInArrow(run, "doc_id long, copy long, start long, ids array<int>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files; the ids stay on the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_parts(_documents(batches), 1 << 22):
            crc = [zlib.crc32(r[3].astype("<u4").tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _listed(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _held(rows: list[tuple]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)
    flat = np.concatenate([r[3] for r in rows]).view(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), ids], names=["doc_id", "copy", "start", "ids"])
