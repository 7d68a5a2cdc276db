"""Words of whole texts as arrays: byte ranges, 64-bit hashes and n-gram hashes, for many texts at a time."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from optiqal.llm._shared import text_bytes

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: After lower-casing: letters a-z, digits and every byte outside ASCII are part of a word.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
VISIBLE = np.ones(256, bool)
VISIBLE[0x09:0x0E] = VISIBLE[0x20] = False

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U)
_LONG = 512


@dataclass
class Words:
    low: np.ndarray  #: lower-cased bytes of all texts
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: number of the first word of each text, and the number of words

    @property
    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def split(text: pa.Array, word: np.ndarray) -> Words:
    """Words of each text; word[b] tells whether byte b is part of one. A null text has none."""
    data, off = text_bytes(text)
    low = LOWER[data]
    if not len(low):
        none = np.zeros(0, np.int64)
        return Words(low, none, none, np.zeros(len(off), np.int64))
    inside = word[low]
    full = off[1:] > off[:-1]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[off[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(low, start, end, np.searchsorted(start, off))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, from eight bytes at a time; equal words have equal hashes in every task."""
    size = w.end - w.start
    if not len(size):
        return np.zeros(0, U)
    padded = np.zeros(len(w.low) + 16, np.uint8)
    padded[: len(w.low)] = w.low
    eight = np.ndarray((len(w.low) + 8,), "<u8", padded.data, strides=(1,))
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    h = mix(h ^ (eight[w.start] & _KEEP[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(at):
        h[at] = mix(h[at] ^ (eight[w.start[at] + done] & _KEEP[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(w.low[w.start[i] : w.end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


_STEPS = mix(np.arange(1, 65, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; n - 1 fewer than words. Texts are not kept apart here."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[: len(h) - n + 1] * _STEPS[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * _STEPS[j]
    return mix(out)


def room(w: Words) -> np.ndarray:
    """How many words each word has from itself to the end of its text."""
    count = np.diff(w.first)
    return np.repeat(w.first[1:], count) - np.arange(w.first[-1])
