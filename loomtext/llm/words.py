"""Numpy text scanning over Arrow string buffers, shared by the operators of this subpackage.

Texts are never decoded to Python strings here: a batch is one byte buffer with
offsets, words are (start, end) byte ranges of it, and hashes are computed for all
words of the batch at once. Batches are cut into slices of about a megabyte, so that
the temporary arrays stay small whatever the size of an Arrow batch; one text that is
longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)

#: Bytes between words: ASCII white space.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between alphanumeric words: ASCII that is neither a lower-case letter nor a digit.
#: (Texts are lower-cased by Spark first; every non-ASCII character belongs to a word.)
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[ord("0") : ord("9") + 1] = False
NOT_ALNUM[ord("a") : ord("z") + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string or binary array; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a column."""
    buf, off = buffers(arr)
    for i, j in slices(off, limit):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def find_words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n+1 values)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    out = gap[buf]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = out[:-1]
    edge = off[:-1]
    before[edge[edge < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = out[1:]
    edge = off[1:]
    after[edge[edge > 0] - 1] = True
    inside = ~out
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def loads(buf: np.ndarray) -> np.ndarray:
    """An unaligned view: element i is the eight bytes from i on, little-endian."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; depends on the bytes alone."""
    size = ends - starts
    view = loads(buf)
    h = mix((view[starts] & _MASKS[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) * _GOLD + np.uint64(seed)))
    rest = np.flatnonzero(size > 8)
    at = 8
    while len(rest):
        left = size[rest] - at
        h[rest] = mix(h[rest] * _GOLD ^ (view[starts[rest] + at] & _MASKS[np.minimum(left, 8)]))
        at += 8
        rest = rest[left > 8]
        if at >= 1024 and len(rest):  # enormous words: one pass each instead of one step of all per 8 bytes
            import xxhash

            for r in rest:
                h[r] = mix(h[r : r + 1] ^ np.uint64(xxhash.xxh3_64_intdigest(buf[starts[r] + at : ends[r]].tobytes())))[0]
            break
    return h


def string_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given byte ranges (whole characters) as a string array."""
    size = ends - starts
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.repeat(starts - off[:-1], size) + np.arange(off[-1])
    data = buf[at] if len(at) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def int_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array over flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
