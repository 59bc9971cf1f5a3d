"""Word positions and rolling hashes of many texts at once, in numpy.

Texts travel as UTF-8 bytes. A slice of an Arrow batch is laid end to end, words
are found with a byte table, and every word or run of words gets a 64-bit
polynomial hash from prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
SPACE = 32

_RANDOM = np.random.default_rng(20_240_501)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = tuple(int(x) | 5 for x in _RANDOM.integers(1, 2**63, 3, dtype=np.uint64))


def _table(separators, lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = SPACE
    return table


_BLANK = (9, 10, 11, 12, 13, 32)
#: Words between ASCII white space, as they are.
PLAIN = _table(_BLANK, lower=False)
#: Words between ASCII white space, A-Z lower-cased.
LOWER = _table(_BLANK, lower=True)
#: Words of digits, letters and everything beyond ASCII, A-Z lower-cased.
ALNUM = _table([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)], lower=True)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]))
                for b in (self.base, self.inverse)
            )
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[start:end] for many ranges, equal for equal contents."""
    up, down = _POWERS[which].upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of several texts: byte range, owner and hash of each; ``first[i]:first[i+1]`` are text i's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        return range_hashes(_BYTE[self.data], self.start, self.end, which)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), joined by one space."""
        data = self.data
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def words_of(texts: list[bytes], table: np.ndarray) -> Words:
    """Find the words of texts under a byte table; separators map to a space."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = table[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = data == SPACE
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(start, bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, owner, first)


def window_hashes(words: Words, hashes: np.ndarray, length: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``length`` words that stays inside one text."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.owner[:n] == words.owner[length - 1 :])
    return at, range_hashes(hashes, at, at + length, which)


def utf8(column) -> list[bytes]:
    """An Arrow text column as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges holding about ``limit`` bytes each, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def carried(schema: T.StructType, added: T.StructType) -> T.StructType:
    """Input columns, without those that a result column replaces, then the result columns."""
    taken = {f.name.lower() for f in added}
    return T.StructType([f for f in schema if f.name.lower() not in taken] + list(added))


def attach(batch: pa.RecordBatch, schema: pa.Schema, results: dict) -> pa.RecordBatch:
    """Batch with result columns, in the order and types of ``schema``."""

    def column(f: pa.Field) -> pa.Array:
        given = results.get(f.name)
        if given is None:
            return batch.column(f.name).cast(f.type)
        return given if isinstance(given, pa.Array) else pa.array(given, f.type)

    columns = [column(f) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
