"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow string arrays.

A word is a maximal run of ASCII digits, ASCII letters (lower-cased) and
non-ASCII bytes. Hashes are 64-bit, depend on the bytes of the word alone, and
are equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
SHINGLE_WORDS = 5
#: Distinct keys that a counting task holds before it hands them on.
HELD = 1 << 20

_BASE = 0x9E3779B97F4A7C15
LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128:
        LOWER[_c] = _c
    elif 65 <= _c <= 90:
        LOWER[_c] = _c + 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each place (modulo _PLACES) and byte of a word, twice.
_PLACES = 64
_TABLES = mix(np.arange(1, 2 * _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(_BASE)).reshape(2, -1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offset of each text; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most so many bytes of text, or one row."""
    i, n = 0, batch.num_rows
    if not n:
        return
    ends = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """The words of some texts: hash, first and past-the-end byte of each, and where each text's words begin.

    A word's hash is the sum of a random number for each of its places and bytes,
    so that no pattern of bytes makes words collide.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = LOWER, wide: bool = False):
        """letters: what each byte counts as; 0 for a byte that stands between words. wide: whether to make `more`, another 64 bits of hash."""
        n = len(data)
        low = letters[data]
        inside = low != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[:-1][offsets[:-1] < n]
        first[cuts] = inside[cuts]
        cuts = offsets[1:][offsets[1:] > 0] - 1
        last[cuts] = inside[cuts]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        index = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        place = index - np.maximum.accumulate(np.where(first, index, 0)) if n else index
        del index
        self._total = self._sums(_TABLES[0], low, place, inside)
        self._before = self._total[self.start]
        self.hash = mix(self._total[self.end] - self._before)
        if wide:
            total = self._sums(_TABLES[1], low, place, inside)
            self.more = mix(total[self.end] - total[self.start])
        self.of = np.searchsorted(self.start, offsets)

    @staticmethod
    def _sums(table: np.ndarray, low: np.ndarray, place: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The sum over all bytes before each. Beyond the table's places, numbers are multiplied by one of their place. A step at a time, for long texts."""
        total = np.zeros(len(low) + 1, np.uint64)
        for a in range(0, len(low), STEP_BYTES):
            at = place[a : a + STEP_BYTES]
            numbers = table[((at & (_PLACES - 1)) << 8) | low[a : a + STEP_BYTES]]
            far = np.flatnonzero(inside[a : a + STEP_BYTES] & (at >= _PLACES))
            numbers[far] *= mix((at[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
            np.cumsum(numbers, out=total[a + 1 : a + 1 + len(at)])
            total[a + 1 : a + 1 + len(at)] += total[a]
        return total

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more bytes than so many, and the hash of their first ones; never that of a word."""
        long = np.flatnonzero(self.end - self.start > size)
        return long, mix(mix(self._total[self.start[long] + size] - self._before[long]) ^ np.uint64(size))

    def counts(self) -> np.ndarray:
        return np.diff(self.of)


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of so many words within a text, and where each text's begin.

    A text with fewer words, but not none, has one shingle of all its words.
    """
    h, of = words.hash, words.of
    counts = np.diff(of)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    starts = np.concatenate([[0], np.cumsum(made)])
    if len(h) < size:
        runs = np.empty(0, np.uint64)
    else:
        runs = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            runs = (runs + h[k : k + len(runs)]) * np.uint64(_BASE)
        runs = mix(runs)
    out = np.empty(int(starts[-1]), np.uint64)
    whole = counts >= size
    if whole.any():
        owner = np.repeat(np.arange(len(counts)), made)
        at = np.arange(len(out)) - starts[owner] + of[owner]
        keep = whole[owner]
        out[keep] = runs[at[keep]]
    for i in np.flatnonzero((counts > 0) & ~whole):
        total = np.zeros(1, np.uint64)
        for x in h[of[i] : of[i + 1]]:
            total = (total + x) * np.uint64(_BASE)
        out[starts[i]] = mix(total ^ np.uint64(counts[i]))[0]
    return out, starts


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with these columns after its own; one of the same name gives way."""
    old = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name not in new}
    return pa.RecordBatch.from_pydict(old | new)


class Counter:
    """Sums of counts by key, merged whenever many are held."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.empty(0, np.uint64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        merged = (keys[first], np.add.reduceat(counts, first) if len(first) else counts)
        self.parts, self.size = [merged], len(first)
        return merged
