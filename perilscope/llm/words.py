"""Words of whole Arrow text columns, found and hashed with numpy.

A text column arrives in a task as one byte buffer with row offsets. Words are
maximal runs of word bytes inside a row; UTF-8 lets a byte table decide for
the classes used here, as every byte above 0x7F belongs to a word. No row is
cut: a text larger than a slice is a slice of its own, and its temporary arrays
are built piece by piece.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")

SLICE_BYTES = 1 << 20  # rows handled together
SPANS_TOGETHER = 1 << 17  # spans hashed together
LONG_SPAN = 1024  # bytes; a longer span is hashed by the hashes of its pieces

# the low bytes of a lane of eight that belong to a span with so many bytes left
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Hand freed memory back: Python workers are kept between tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, held by this worker for later tasks under ``name``; only one thing is held."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """Forget what earlier tasks of other operators left in this worker."""
    if _kept:
        _kept.clear()
        release()


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for every byte but those in the (first, last) ranges."""
    table = np.ones(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = False
    return table


#: After A-Z became a-z: a-z, 0-9 and everything beyond ASCII.
ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Everything but white space.
NON_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return bytes_, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte stays."""
    return _LOWER[data]


def row_slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``size`` bytes; at least one row each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def batches(
    stream: Iterator[pa.RecordBatch], column: str, size: int | None = None
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the record batches with the bytes and offsets of a text column."""
    for batch in stream:
        data, offsets = buffer(batch.column(batch.schema.get_field_index(column)))
        for first, last in row_slices(offsets, size or SLICE_BYTES):
            yield (
                batch.slice(first, last - first),
                data[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
        del batch, data, offsets
    release()


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (and the total)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    joined = cuts[inside[cuts - 1] & inside[cuts]]  # a word runs over a row's end: both rows have a part
    flips = np.flatnonzero(edge)
    if len(joined):
        flips = np.sort(np.concatenate([flips, joined, joined]))
    starts, ends = flips[0::2], flips[1::2]
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; equal bytes have equal hashes.

    The bytes go in by lanes of eight and are mixed after every lane, so that no pattern of the bytes
    makes two spans equal but chance. Hashes of two seeds are independent: both together tell 2^128 spans apart.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.zeros((len(data) + 23) // 8 * 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = padded.view(np.uint64)
    for k in range(0, len(starts), SPANS_TOGETHER):
        part = slice(k, k + SPANS_TOGETHER)
        out[part] = _by_lanes(words, starts[part].astype(np.int64), (ends[part] - starts[part]).astype(np.int64), seed)
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        cuts = np.arange(starts[i], ends[i], LONG_SPAN)
        pieces = hashes(data, cuts, np.minimum(cuts + LONG_SPAN, ends[i]), seed).view(np.uint8)
        out[i] = hashes(pieces, np.zeros(1, np.int64), np.array([len(pieces)]), seed + 1)[0]
    return out


def _by_lanes(words: np.ndarray, at: np.ndarray, left: np.ndarray, seed: int) -> np.ndarray:
    state = mix(left.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    rows = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
    at, left = at[rows], left[rows]
    while len(rows):
        shift = ((at & 7) << 3).astype(np.uint64)
        lane = (words[at >> 3] >> shift) | (words[(at >> 3) + 1] << np.uint64(1) << (np.uint64(63) - shift))
        state[rows] = mix(state[rows] ^ (lane & _LOW[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return state


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def ragged(lengths: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indices of many ranges one after the other: firsts[i] .. firsts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    shift = np.repeat(firsts - (ends - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def known(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in ``sorted_keys``, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)
