"""Vectorised words and hashes over Arrow text columns, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are taken at once.
SLICE = 1 << 20
#: Words of up to so many times eight bytes are hashed in columns, longer ones one by one.
_CHUNKS = 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b + U64(0x2545F4914F6CDD1D)))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes; the caller drops those that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.zeros(n, U64)
    for j in range(k):
        acc = acc * U64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mix(acc)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; nothing is copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of up to ``size`` bytes, one row at least."""
    _, offsets = text_bytes(column) if len(column) else (None, np.zeros(1, np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, len(column))
        at = min(end, len(column))


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words up to each offset; ``space`` tells the bytes between words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, lower: bool, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end): equal words have equal hashes.

    Eight bytes at a time are mixed into a state that begins with the length, so words of up to eight bytes
    and one length never share a hash; words of over ``_CHUNKS`` * 8 bytes are hashed by xxh64.
    """
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    starts, ends, per_row = word_bounds(data, offsets, space)
    size = ends - starts
    out = mix(size.astype(U64) * U64(0xA0761D6478BD642F) + U64(0x5851F42D4C957F2D))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # The eight bytes from any place as one number: strides of one byte over the same memory.
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    short = size <= 8 * _CHUNKS
    rows = np.flatnonzero(short) if not short.all() else np.arange(len(size))
    at, left = starts[rows], size[rows]
    while len(rows):
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        out[rows] = mix((out[rows] ^ part) * U64(0xD6E8FEB86659FD93))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=1)
    return out, per_row


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that the shuffle's compression drops the empty ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length; the first is sorted and stored as differences."""
    n = len(columns[0])
    out = [np.array([n], "<i8").tobytes()]
    for i, c in enumerate(columns):
        out.append(planes(np.diff(c, prepend=c.dtype.type(0)) if i == 0 else np.ascontiguousarray(c)))
    return b"".join(out)


def unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data[:8], "<i8")[0]), 8, []
    for i, d in enumerate(dtypes):
        size = n * np.dtype(d).itemsize
        c = unplanes(data[at : at + size], n, d)
        out.append(np.cumsum(c, dtype=d) if i == 0 else c)
        at += size
    return out
