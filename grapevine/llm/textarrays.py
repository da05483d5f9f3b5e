"""Words, shingles and byte hashes of Arrow text columns as numpy arrays.

Texts stay one byte buffer with offsets, so no Python string is made per word. Hashes are 64 bits wide and the same on
every machine. Working arrays follow the bytes of a chunk, and a chunk holds about ``CHUNK`` bytes or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[SPACES] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit values so that all bits depend on all bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * CHUNK:
            _powers[base] = have
    return have[:n]


@dataclass
class Chunk:
    """Rows ``first`` to ``last`` of a batch: their bytes and where each text starts and ends in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Consecutive rows of about ``limit`` bytes, one row at least. Null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        own = offsets[first:last + 1]
        yield Chunk(first, last, data[own[0]:own[-1]], own - own[0])
        first = last


@dataclass
class Words:
    """Words of a chunk: byte ranges, 64-bit hashes, and for each text the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def words_of(chunk: Chunk, lower: bool = False) -> Words:
    """Runs of bytes other than space and \\t to \\r. ``lower`` takes A-Z as a-z in the hashes."""
    data = chunk.data
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(chunk) + 1, dtype=np.int64))
    inside = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    offsets = np.searchsorted(starts, chunk.offsets)
    if len(starts) == 0:
        return Words(starts, ends, np.zeros(0, dtype=np.uint64), offsets)
    value = BYTE_VALUE[LOWER[data]] if lower else BYTE_VALUE[data]
    value *= powers(BASE, n)
    value[~inside] = 0
    hashes = np.add.reduceat(value, starts) * powers(BASE_INVERSE, n)[starts]
    return Words(starts, ends, mix(hashes), offsets)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``size`` words that start here, whether they end inside the text), for every word."""
    n = len(words.hashes)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total[:max(n - k, 0)] += words.hashes[k:] * np.uint64(pow(BASE, k + 1, 1 << 64))
    inside = np.zeros(n, dtype=bool)
    lengths = np.diff(words.offsets)
    left = np.repeat(words.offsets[1:], lengths) - np.arange(n)
    inside = left >= size
    return mix(total), inside


def byte_grams(chunk: Chunk, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes that start at each byte, where so many are left in the chunk; texts are not kept apart."""
    value = BYTE_VALUE[chunk.data]
    value *= powers(BASE, len(value))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    n = max(len(value) - size + 1, 0)
    return mix((total[size:size + n] - total[:n]) * powers(BASE_INVERSE, len(value))[:n])


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    width, least = 1, values
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    gap = size - width
    if len(least) <= gap:
        return least[:0]
    return np.minimum(least[:len(least) - gap], least[gap:]) if gap else least


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes text by text, each text's range in them), sorted inside a text.

    A text of fewer words than ``size`` has one shingle, all its words; a text without words has none.
    """
    hashes, inside = windows(words, size)
    lengths = np.diff(words.offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)[inside]
    values = hashes[inside]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        whole = lengths[short].astype(np.uint64) * BYTE_VALUE[0]
        for k in range(size - 1):
            has = lengths[short] > k
            whole[has] += words.hashes[words.offsets[short[has]] + k] * powers(BASE, size + 1)[k + 1]
        owner = np.concatenate([owner, short])
        values = np.concatenate([values, mix(whole)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    owner, values = owner[fresh], values[fresh]
    return values, np.searchsorted(owner, np.arange(len(lengths) + 1))


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose i-th value holds the bytes of ``values[offsets[i]:offsets[i + 1]]``."""
    width = values.dtype.itemsize
    body = np.ascontiguousarray(values)
    ends = (np.asarray(offsets, dtype=np.int64) - offsets[0]) * width
    if len(ends) and ends[-1] >= 2**31:
        raise ValueError("a binary column of one batch holds less than 2 GB; make the chunks smaller")
    part = body[offsets[0]:offsets[-1]] if len(body) else body
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(part.tobytes())]
    )


def concatenated(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and each value's range in it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    width = np.dtype(dtype).itemsize
    return data.view(dtype), (offsets - offsets[0]) // width
