"""One-permutation MinHash fingerprints.

The shingle hashes of a text are dealt to ``bins`` by their high bits once; each
bin keeps its least hash.  Empty bins borrow by optimal densification: bin i asks
the bins in a fixed random order of its own until one is not empty.  Stored
are the low-order ``bits`` of each bin; likeness is the share of equal bins,
corrected for chance equality: (m - c) / (1 - c) with c = 2^-bits, within 0..1.

Shingles are five words (A-Z folded); a shorter text with words is one shingle.
A null or blank text has no shingle: its fingerprint is the empty string, like
only to another such text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.arrays import U64, Words, chunks, mix, texts_of
from wayfare.llm.storage import bound_batches

EMPTY = np.iinfo(np.uint64).max


class OnePermutation:
    """Signatures of texts; ``bins`` a power of two, ``bits`` 4 or 8."""

    def __init__(self, bins: int = 512, bits: int = 4, width: int = 5):
        if bins & (bins - 1) or bits not in (4, 8):
            raise ValueError("bins must be a power of two and bits 4 or 8")
        self.bins, self.bits, self.width = bins, bits, width
        cells = np.arange(bins * bins, dtype=U64).reshape(bins, bins)
        self.orders = np.argsort(mix(cells * U64(0x9E3779B1) + U64(77)), axis=1, kind="stable")
        self.ranks = np.argsort(self.orders, axis=1, kind="stable").astype(np.uint16)

    def signatures(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Low bits of every bin (texts x bins, uint8), and which texts have words."""
        out = np.zeros((len(texts), self.bins), dtype=np.uint8)
        some = np.zeros(len(texts), dtype=bool)
        for first, last in chunks(texts):
            words = Words(texts[first:last])
            for a in range(0, last - first, 512):
                b = min(a + 512, last - first)
                out[first + a : first + b], some[first + a : first + b] = self._minima(words, a, b)
        return out, some

    def _minima(self, words: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(words, "of_width"):
            words.of_width = words.shingles(self.width)
        hashes, doc = words.of_width
        lo, hi = np.searchsorted(doc, [a, b])
        hashes, doc = hashes[lo:hi], doc[lo:hi] - a
        least = np.full((b - a) * self.bins, EMPTY, dtype=U64)
        cell = doc * self.bins + (hashes >> U64(64 - self.bins.bit_length() + 1)).astype(np.int64)
        np.minimum.at(least, cell, hashes)
        least = least.reshape(b - a, self.bins)
        some = np.zeros(b - a, dtype=bool)
        some[doc] = True
        self._densify(least, least != EMPTY, some)
        # remixed by bin: a borrowed hash must not agree by chance in all bins at once
        own = mix(least + np.arange(self.bins, dtype=U64)[None, :] * U64(0xD1342543DE82EF95))
        return (own & U64((1 << self.bits) - 1)).astype(np.uint8), some

    def _densify(self, least: np.ndarray, given: np.ndarray, some: np.ndarray) -> None:
        """Empty bins take the hash of the first given bin in their own fixed random order of all bins."""
        rows = np.flatnonzero(some & ~given.all(axis=1))
        for attempt in range(8):
            if not len(rows):
                return
            asked = self.orders[:, attempt]
            missing = least[rows] == EMPTY
            can = missing & given[rows][:, asked]
            at, column = np.nonzero(can)
            least[rows[at], column] = least[rows[at], asked[column]]
            rows = rows[(missing & ~can).any(axis=1)]
        for row in rows:  # few bins are given: look for the first of them at once
            have, need = np.flatnonzero(given[row]), np.flatnonzero(least[row] == EMPTY)
            least[row, need] = least[row, have[np.argmin(self.ranks[np.ix_(need, have)], axis=1)]]

    def pack(self, signatures: np.ndarray, some: np.ndarray) -> list[str]:
        packed = signatures if self.bits == 8 else signatures[:, ::2] << 4 | signatures[:, 1::2]
        return [row.tobytes().hex() if ok else "" for row, ok in zip(packed, some, strict=True)]

    def likeness(self, a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
        chance = 2.0**-self.bits
        value = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
        return np.where(some_a & some_b, value, (some_a == some_b).astype(float))

    def likeness_of(self, a: str, b: str) -> float:
        """Likeness of two stored fingerprints."""
        if not a or not b:
            return float(a == b)
        x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
        if self.bits == 4:
            x, y = (np.stack([v >> 4, v & 15]) for v in (x, y))
        chance = 2.0**-self.bits
        return float(np.clip(((x == y).mean() - chance) / (1 - chance), 0, 1))


def fingerprints(docs: DataFrame, method: OnePermutation | None = None) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    method = method or OnePermutation()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = method.pack(*method.signatures(texts_of(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(packed, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")
