"""Words of Arrow text columns as NumPy arrays.

Text is handled as UTF-8 bytes in chunks of bounded size. A chunk holds whole
documents; one that is larger than the bound makes a chunk of its own. A word
is known by its position and a 64-bit hash, so no Python object is made for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
HASHED_BYTES = 1 << 17

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def byte_class(separators: np.ndarray, lower: bool) -> np.ndarray:
    """Table byte -> the byte of the word it belongs to, 0 for a separator; the zero byte stands as 0xFF, which UTF-8 lacks."""
    table = (_ASCII_LOWER if lower else np.arange(256, dtype=np.uint8)).copy()
    table[0] = 0xFF
    table[separators] = 0
    return table


_BLANK = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_NOT_ALNUM = np.array([b for b in range(0x80) if not chr(b).isalnum()])

#: words ``[^\x20\x09-\x0D]+``, as written and with A-Z lowered
SPACED = byte_class(_BLANK, lower=False)
SPACED_LOWER = byte_class(_BLANK, lower=True)
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lowered
ALNUM_LOWER = byte_class(_NOT_ALNUM, lower=True)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = 0 if have is None else min(2 * len(have), CHUNK_BYTES + 1)
        have = np.full(max(n, grown, HASHED_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 8 * CHUNK_BYTES:  # powers for one huge document are not kept
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offs


@dataclass
class Words:
    """Words of rows ``first .. first + len(rows) - 1`` of a column.

    data: bytes of the chunk; text: row offsets into it; start, end: of each
    word, in bytes; rows: word offsets of each row; hash: of each word.
    """

    first: int
    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    hash: np.ndarray

    @property
    def n(self) -> int:
        return len(self.rows) - 1

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, word, side="right") - 1


def spans(mask: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true bytes; runs end with their row."""
    n = len(mask)
    edge = np.zeros(n + 1, dtype=bool)
    edge[text] = True
    change = np.empty(n + 1, dtype=bool)
    change[0] = change[n] = True
    np.not_equal(mask[1:], mask[:-1], out=change[1:n])
    cut = np.flatnonzero(change | edge)
    inside = mask[cut[:-1]]
    return cut[:-1][inside], cut[1:][inside]


def hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, in order and apart (polynomial, then mixed).

    A hash doesn't depend on where its span lies, so ``HASHED_BYTES`` are worked
    on at once: sums and powers take 32 bytes for each.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        first = start[i]
        j = int(np.searchsorted(start, first + HASHED_BYTES))
        n = int(end[j - 1] - first)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[values[first:end[j - 1]]] * _power(_BASE, n + 1, "base")[:n], out=sums[1:])
        out[i:j] = mix((sums[end[i:j] - first] - sums[start[i:j] - first]) * _power(_INVERSE, n + 1, "inverse")[start[i:j] - first], 1)
        i = j
    return out


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def words(column: pa.Array, table: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a text column under a byte table, chunk by chunk."""
    for first, data, text in chunks(*utf8(column), limit):
        values = table[data]
        if len(values):
            start, end = spans(values != 0, text)
            h = hashes(values, start, end)
        else:
            start = end = np.empty(0, np.int64)
            h = np.empty(0, np.uint64)
        yield Words(first, data, text, start, end, np.searchsorted(start, text), h)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start[i] .. start[i] + count[i] - 1, one after the other."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, count)


def row_sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
