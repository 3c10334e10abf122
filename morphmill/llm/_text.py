"""Whole texts of an Arrow batch as numpy arrays: words, word hashes and shingles.

Everything works on the batch's UTF-8 bytes at once. Words are runs of
``[^\\x20\\x09-\\x0D]+``; no such byte occurs inside a multi-byte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes, one text at least.
SLICE_BYTES = 1 << 20
#: Longer words take a digest instead of the polynomial hash, which bounds its tables.
LONG_WORD = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_R = 0x9E3779B97F4A7C15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _tables or len(_tables["r"]) < n:
        for name, r in (("r", _R), ("inverse", pow(_R, -1, 1 << 64))):
            table = np.full(n, r, np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["r"], _tables["inverse"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; ``gaps`` says which bytes are between words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = gaps[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    before[heads] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[heads[heads > 0] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``table`` is 0 for the bytes between words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        lo, hi = starts[i], ends[j - 1]
        if j == i + 1 and hi - lo > LONG_WORD:
            out[i] = int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little")
            i = j
            continue
        r, inverse = _powers(max(int(hi - lo), SLICE_BYTES) + 1)
        s = starts[i:j] - lo
        out[i:j] = np.add.reduceat(table[data[lo:hi]] * r[: hi - lo], s) * inverse[s]
        long = np.flatnonzero(ends[i:j] - starts[i:j] > LONG_WORD)
        for k in long + i:
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k neighbouring words, by its first word."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out + hashes[j : j + n])
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z lower-cased.

    A text of fewer words, but one at least, has its whole sequence as one
    shingle; a text without words has none.
    """
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        part = lower(data[offsets[i] : offsets[j]])
        offs = offsets[i : j + 1] - offsets[i]
        starts, ends, doc = word_bounds(part, offs)
        hashes = word_hashes(part, starts, ends)
        grams = windows(hashes, k)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix(windows(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


_CHAR_START = (np.arange(256) & 0xC0) != 0x80


def char_offsets(data: np.ndarray) -> np.ndarray:
    """The number of characters before each byte, and in all."""
    return np.concatenate(([0], np.cumsum(_CHAR_START[data], dtype=np.int64)))


def run_hashes(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each run of neighbouring hashes; runs are at ``first``, touch, and cover all."""
    if not len(first):
        return np.zeros(0, np.uint64)
    r, inverse = _powers(len(hashes) + 1)
    return mix(np.add.reduceat(mix(hashes) * r[: len(hashes)], first) * inverse[first] + counts.astype(np.uint64))


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the newline) and text number of each ``\\n``-split line; an empty text has one empty line."""
    cuts = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], cuts + 1)))
    ends = np.sort(np.concatenate((offsets[1:], cuts)))
    # a newline at a text's end opens an empty line of that text, before the next text's start
    first = np.searchsorted(cuts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first) + 1)
    return starts, ends, doc


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line's bytes; all empty lines have the same."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(ends > starts)
    out[full] = word_hashes(data, starts[full], ends[full], _BYTE_OF_LINE)
    return out


_BYTE_OF_LINE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_OF_LINE[10] = 0
