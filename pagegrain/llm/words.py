"""Words and word-sequence hashes of a whole Arrow column at once.

Texts are looked at as UTF-8 bytes. Hashes are polynomials modulo 2**64 over prefix sums, so a
word's hash does not depend on where the word stands, and the hash of any run of words takes two
lookups. All results cover whole texts; a chunk only bounds how many texts are in memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words are runs of anything but space and the five ASCII controls 0x09-0x0D.
SPACED = ~_ASCII_SPACE
#: Words are runs of digits, ASCII lower-case letters and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (base, inverse))
        if size <= CHUNK_BYTES * 2:
            _POWERS[int(base)] = have
    return have


def _prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


@dataclass
class Words:
    """The words of several texts in order. ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        sums = _prefix(_BYTE_VALUE[self.data], _BYTE_BASE)
        h = sums[self.end] - sums[self.start]
        if len(self.start):
            h *= _powers(_BYTE_BASE, len(self.data))[1][self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_of(self, i: int, j: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True)]


class RunHash:
    """Hashes of runs of words, from the words' own hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sums, self.n = _prefix(hashes, _WORD_BASE), len(hashes)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        h = (self.sums[end] - self.sums[start]) * _powers(_WORD_BASE, self.n + 1)[1][start]
        return mix(h + (end - start).astype(np.uint64))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, max_bytes: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``max_bytes`` of text each; a longer text is a slice of its own."""
    _, offs = texts_of(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def split(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> Words:
    """Cuts texts into words; ``word`` says which bytes belong to words. No word crosses two texts."""
    inside = word[data]
    left, right = np.zeros_like(inside), np.zeros_like(inside)
    left[1:], right[:-1] = inside[:-1], inside[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    left[edge] = False
    right[edge - 1] = False
    start = np.flatnonzero(inside & ~left)
    end = np.flatnonzero(inside & ~right) + 1
    return Words(data, start, end, np.searchsorted(start, offs))
