"""Words of whole columns of text as arrays, and hashes of word sequences, computed with numpy.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, which is `[^\\x20\\x09-\\x0D]+` on UTF-8. Words are never cut and never skipped.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b" \t\n\x0b\x0c\r"
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Longer words are hashed one by one with blake2b.
LONG_WORD = 256

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    return mix(a * _M1 + (b ^ (b >> np.uint64(32))) * _M3 + _M2)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, followed by eight zeros
    first: np.ndarray  # per text, index of its first word; one more entry at the end
    start: np.ndarray  # per word
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """Per word, the row of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, with eight zeros behind, and the offsets of the texts. NULL is empty."""
    empty = b"" if pa.types.is_large_binary(column.type) else ""
    column = pc.fill_null(column, empty).cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), at - at[0]


def split_words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data) - 8
    inside = ~_SEPARATES[data[:n]]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, np.searchsorted(start, offsets), start, end)


def hash_words(words: Words) -> np.ndarray:
    """One 64-bit hash per word."""
    data, start = words.data, words.start
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = words.end - start
    out = length.astype(np.uint64) * _M1
    todo = np.arange(len(start))
    for at in range(0, LONG_WORD, 8):
        left = np.minimum(length[todo] - at, 8).astype(np.uint64)
        part = eight[start[todo] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        out[todo] = mix(out[todo] ^ part * _M3)
        todo = todo[length[todo] > at + 8]
        if not len(todo):
            break
    for w in todo:
        whole = data[start[w] : words.end[w]].tobytes()
        out[w] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    return out


def hash_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n items, by doubling; entry i covers items i to i + n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    whole, covered, power, size = None, 0, hashes, 1
    while True:
        if n & size:
            whole = power if whole is None else pair(whole[: len(power) - covered], power[covered:])
            covered += size
        if covered == n:
            return whole[: len(hashes) - n + 1]
        power = pair(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2


def starts_of(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the flat word list at which a run of n words of one text starts, and its text."""
    runs = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(runs)), runs)
    inner = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return first[:-1][text] + inner, text


def spell(words: Words, chosen: np.ndarray) -> list[bytes]:
    return [words.data[a:b].tobytes() for a, b in zip(words.start[chosen], words.end[chosen])]
