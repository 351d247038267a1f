"""Whole texts as numpy arrays: chunks of documents, words and rolling hashes.

Everything works on bounded chunks of some documents; only one document longer
than a chunk makes a chunk of its own length.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 & ~7 | 5)  # 5 modulo 8: swaps of bytes change the hash
_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"").to_pylist()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n places at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words (runs without ASCII white space) of some documents, with 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.docs = len(texts)
        joined = b" ".join(texts) + b" "
        self.bytes = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        word = ~_SPACE[self.bytes]
        edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(joined)))
        self.per_doc = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.per_doc)
        folded = _LOWER[self.bytes] if lower else self.bytes
        up, down = powers(len(joined) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE_VALUES[folded] * up[: len(joined)])])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every shingle; a shorter text that has words is one shingle."""
        n = len(self.hash)
        counts = np.where(self.per_doc >= width, self.per_doc - width + 1, (self.per_doc > 0).astype(np.int64))
        doc = np.repeat(np.arange(self.docs), counts)
        offset = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
        at = self.first[:-1][doc] + offset
        size = np.minimum(self.per_doc[doc], width)
        out = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for k in range(width):
                inside = k < size
                value = self.hash[np.minimum(at + k, max(n - 1, 0))] if n else out
                out = np.where(inside, mix(out * U64(31) + value + U64(k + 1)), out)
        return out, doc
