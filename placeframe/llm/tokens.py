"""Words of whole Arrow batches as NumPy arrays: no Python object for a word or a text.

A word is a maximal run of bytes other than blank and 9 to 13 in the UTF-8 text. It is named by 128 bits in two lanes, a
keyed hash of its bytes, eight at a time, and of its length; a sequence of words is named by 128 bits of the words' names.
Names of 64 bits would meet by chance among the windows of a very large corpus; 128 bits don't, and the key keeps
equal names from being made on purpose. Operators that remove or link compare the words themselves besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at a time; a longer text is a part of its own.
PART_BYTES = 2 << 20

#: Two lanes of names.
Lanes = tuple[np.ndarray, np.ndarray]

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _drawn(what: str, n: int) -> np.ndarray:
    """n numbers of 64 bits drawn from the key."""
    return np.frombuffer(hashlib.shake_256(f"placeframe words: {what}".encode()).digest(8 * n), "<u8").copy()


_KEY = _drawn("bytes", 4)
_MOST = 64
_FACTORS = _drawn("places", 2 * _MOST).reshape(2, _MOST) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def parts(batch: pa.RecordBatch, column: str = "text", most: int = PART_BYTES, step: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts of the rows' texts and the end) for runs of rows of about `most` bytes.

    A run holds a multiple of `step` rows.
    """
    col = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(col):
        end = max(row + step, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end -= (end - row) % step
        at = offsets[row : end + 1]
        yield row, end, data[at[0] : at[-1]], at - at[0]
        row = end


class Words:
    """The words of one part: where each starts and ends, the row it belongs to and, for each row, its first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def names(self) -> Lanes:
        """128 bits for each word."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        length = self.ends - self.starts
        a, b = _KEY[0] + length.astype(np.uint64), np.full(len(length), _KEY[1])
        rows, at, left = None, self.starts, length
        while len(at):
            block = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
            if rows is None:
                a = mix(a ^ block ^ _KEY[2])
                b = mix(b + block * _KEY[3] + a)
            else:
                a[rows] = own = mix(a[rows] ^ block ^ _KEY[2])
                b[rows] = mix(b[rows] + block * _KEY[3] + own)
            more = np.flatnonzero(left > 8)
            rows = more if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
        return a, b

    def array(self) -> pa.Array:
        """The words' bytes."""
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.inside])])


def sequences(names: Lanes, k: int) -> Lanes:
    """128 bits for the k words from each place on; the last k - 1 places are left out."""
    n = len(names[0]) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    sums = []
    for lane, factors in zip(names, _FACTORS, strict=True):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += lane[i : i + n] * (factors[i] if i < _MOST else mix(factors[i % _MOST] + np.uint64(i)) | np.uint64(1))
        sums.append(total)
    a = mix(sums[0] + np.uint64(k))
    return a, mix(sums[1] ^ a)


def rows_of(parts_of: Iterable[dict[str, np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of the arrays given by name; unsigned numbers become signed ones bit for bit."""
    for part in parts_of:
        arrays = [np.ascontiguousarray(x).view(np.int64) if isinstance(x := part[f.name], np.ndarray) and x.dtype == np.uint64 else x for f in schema]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)
