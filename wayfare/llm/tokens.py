"""Byte-level BPE of the tokenizers library with a bounded memory of words.

The library's model gives each word of its pre-tokenizer its ids independently of the rest, so
that a word seen before needs no second call, and a new one goes to the model alone.  Texts with characters beyond
a plain set (ASCII, Latin letters and signs, common punctuation), for which word boundaries could differ
between regular expression engines, go to the library whole, as do texts that hold a special token where
those are read.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Words of one generation; two are remembered.
REMEMBERED = 200_000
_PLAIN = [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
#: Bytes that stand for themselves in the vocabulary; the others are the characters from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHAR_OF = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_AS_CHARS = {b: ord(c) for b, c in _CHAR_OF.items()}


def _class(kind: str) -> str:
    """Ranges of the plain characters of a Unicode category, for a regular expression."""
    codes = [c for c in _PLAIN if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


_L, _N = _class("L"), _class("N")
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\\t\\n\\r" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ((0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))) + "]")


class _Known(dict):
    """Ids of words as bytes in two generations: what is asked for again outlives what is not."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize = tokenize
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            chars = word.encode().decode("latin-1").translate(_AS_CHARS)
            out = np.array([t.id for t in self.tokenize(chars)], dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class Encoder:
    """``encode`` gives unsigned 32-bit ids; ``specials`` keeps the library's reading of special tokens inside texts."""

    def __init__(self, path: str, specials: bool = True):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()] if specials else []
        self.known = _Known(self.library.model.tokenize)

    def encode(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text) or any(m in text for m in self.marks):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        known = self.known
        return np.frombuffer(b"".join([known[w] for w in WORDS.findall(text)]), dtype="<u4")

    @functools.cached_property
    def pieces(self) -> dict[int, bytes]:
        """Bytes of every id."""
        byte_of = {c: b for b, c in _CHAR_OF.items()}
        added = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
        return {i: bytes(byte_of[c] for c in t) for t, i in self.library.get_vocab(with_added_tokens=False).items() if i not in added} | added

    def decode(self, ids) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode()


@functools.lru_cache(maxsize=4)
def encoder(path: str, specials: bool = True) -> Encoder:
    """One for each process."""
    return Encoder(path, specials)
