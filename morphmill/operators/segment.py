"""Segmentation of single strings: small helpers that run inside Spark tasks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWEST = -math.inf


def char_starts(text: bytes) -> list[bool]:
    """Whether each byte starts a character."""
    return [b & 0xC0 != 0x80 for b in text]


def unspanned(pieces: Iterable[bytes], mark: bytes) -> bool:
    """Whether no piece can go on over the start of a ``mark``: none has it, or a first part of it at its end, after its own start."""
    for p in pieces:
        for j in range(1, len(p)):
            if p[j : j + len(mark)] == mark[: len(p) - j]:
                return False
    return True


def cut_before(text: str, mark: str) -> list[str]:
    """A text cut before each ``mark``; the parts joined are the text."""
    first, *rest = text.split(mark)
    return ([first] if first else []) + [mark + x for x in rest]


class Unigram:
    """Most probable cut into dictionary entries; a character alone is possible at a fixed low weight.

    Entries are a prefix tree: a walk from a place goes on only as long as some entry does.
    """

    #: Scores nearer to each other than this may be told apart otherwise in a longer text, by rounding.
    NEAR = 1e-6

    def __init__(self, scores: dict[bytes, float], fallback: float = -10.0, total: float | None = None):
        """``total``: the sum of all scores, where ``scores`` are only those that some texts can use."""
        total = sum(scores.values()) if total is None else total
        self.weights = {k: math.log(v) - math.log(total) for k, v in scores.items() if k and v > 0}
        self.fallback = fallback
        self.tree: dict = {}
        for piece, w in self.weights.items():
            node = self.tree
            for b in piece:
                node = node.setdefault(b, {})
            node[-1] = w

    def cut(self, text: bytes) -> list[bytes]:
        return self.cut_and_tie(text)[0]

    def cut_and_tie(self, text: bytes) -> tuple[list[bytes], bool]:
        """The best cut, and whether it was nearly or exactly as good as another in some place."""
        n, tie = len(text), False
        best, came = [LOWEST] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        starts = [i for i, s in enumerate(char_starts(text)) if s or i == 0]
        for k, i in enumerate(starts):
            here = best[i]
            char_end = starts[k + 1] if k + 1 < len(starts) else n
            # the single character first, then entries by length: a later one must be better
            now = here + self.fallback
            tie = tie or abs(now - best[char_end]) < self.NEAR
            if now > best[char_end]:
                best[char_end], came[char_end] = now, i
            node, end = self.tree, i
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                if (w := node.get(-1)) is not None:
                    now = here + w
                    tie = tie or abs(now - best[end]) < self.NEAR
                    if now > best[end]:
                        best[end], came[end] = now, i
        out, end = [], n
        while end:
            out.append(text[came[end] : end])
            end = came[end]
        return out[::-1], tie


#: n-grams have up to six bytes, which fit into a number beside their length.
MOST = 6
#: Bytes of words that are cut together, as a table of words by places.
TABLE_BYTES = 1 << 19


def ngram_table(grams: pa.Array, logps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, log probabilities) of n-grams, in order of the numbers."""
    sizes = pc.binary_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(grams.to_pylist()) + bytes(MOST), np.uint8)
    keys = sizes.copy()
    for k in range(MOST):
        inside = k < sizes
        keys[inside] = (keys[inside] << 8) | data[offsets[:-1][inside] + k]
    order = np.argsort(keys)
    return keys[order], logps.to_numpy(zero_copy_only=False)[order]


def _cuts(text: np.ndarray, sizes: np.ndarray, keys: np.ndarray, logps: np.ndarray) -> np.ndarray:
    """Where pieces start, of words as rows of a table, by Viterbi steps over all rows.

    A state is a byte's offset in its piece, up to MOST - 1; from there it stays,
    so pieces can be longer than n-grams. Pieces start at characters. Of equal
    scores the smaller previous state wins.
    """
    n, wide = text.shape
    starts = (text & 0xC0) != 0x80
    starts[:, 0] = True
    score = np.full((n, MOST), -np.inf)
    final = np.zeros(n, np.int64)
    back = np.zeros((wide, n, MOST), np.int8)
    rows = np.arange(n)
    # of the n-grams that end here, those of each length, without and with their length
    bare = [np.zeros(n, np.int64) for _ in range(MOST)]
    into = np.zeros(n, np.int64)
    for i in range(wide):
        byte = text[:, i].astype(np.int64)
        bare = [byte] + [(b << 8) | byte for b in bare[:-1]]
        into = np.where(starts[:, i], 0, into + 1)
        now = np.full((n, MOST), -np.inf)
        for j in range(min(i + 1, MOST)):
            key = bare[j] | ((j + 1) << (8 * (j + 1)))
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            own = np.where((keys[at] == key) & (into <= j), logps[at], -np.inf)
            if i == 0:
                now[:, 0] = own
                continue
            begins = starts[:, i - j]
            if j == 0:
                prev = score.argmax(axis=1)
                top = score[rows, prev]
            else:
                prev, top = np.full(n, j - 1), np.where(begins, score[:, j - 1], -np.inf)
                if j == MOST - 1:
                    stays = score[:, j] + own > top + own
                    prev, top = np.where(stays, j, prev), np.where(stays, score[:, j], top)
            total = top + own
            now[:, j] = total
            back[i, :, j] = np.where(total > -np.inf, prev, 0)
        score = now
        ended = sizes == i + 1
        if ended.any():
            final[ended] = now[ended].argmax(axis=1)
    cuts = np.zeros((n, wide), bool)
    state = np.zeros(n, np.int64)
    for i in range(wide - 1, 0, -1):
        state = np.where(sizes == i + 1, final, state)
        live = i < sizes
        cuts[:, i] = live & (state == 0) & starts[:, i]
        state = np.where(live, back[i, rows, state], state)
    cuts[:, 0] = True
    return cuts


def cut_by_ngrams(words: pa.Array, keys: np.ndarray, logps: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The best pieces of words under byte n-gram log probabilities, and the number of each piece's word.

    Words of about one length go through together, a step for each place.
    """
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    if not len(words):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    sizes = np.diff(offsets)
    opens = np.zeros(len(data), bool)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    k = 0
    while k < len(order):
        # rows times the longest of them stay in the table; one word at least
        last = np.arange(k, len(order))
        last = last[: max(1, int(np.searchsorted((last - k + 1) * sizes[order[last]], TABLE_BYTES, "right")))][-1] + 1
        some = order[k:last]
        wide = int(sizes[some].max())
        at = offsets[some][:, None] + np.arange(wide)
        inside = np.arange(wide) < sizes[some][:, None]
        text = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        opens[at[inside]] = _cuts(text, sizes[some], keys, logps)[inside]
        k = last
    place = np.flatnonzero(opens)
    bounds = np.append(place, len(data)).astype(np.int32)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(offsets, place, "right") - 1


def ngram_cuts(text: bytes, table: dict[bytes, float]) -> list[bytes]:
    """``cut_by_ngrams`` of one word."""
    entries = ngram_table(pa.array(list(table), pa.binary()), pa.array(list(table.values()), pa.float64()))
    return cut_by_ngrams(pa.array([text], pa.binary()), *entries)[0].to_pylist()


#: Symbols of a text whose pairs are looked through for each merge; those of a longer one are in a heap.
SHORT = 48


def merge_ids(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Merge pairs by rank, the leftmost of the lowest first; a pair's rank is its new id."""
    n = len(ids)
    ids = list(ids)
    if n <= SHORT:
        none, get = 1 << 62, ranks.get
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found and (rank := min(found)) < none:
            i = found.index(rank)
            ids[i] = rank
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = get((rank, ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], rank), none)
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i] if ids[i] == left else n
        if j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get((rank, ids[after[j]]))) is not None:
                heapq.heappush(heap, (r, i, rank, ids[after[j]]))
        if before[i] >= 0 and (r := ranks.get((ids[before[i]], rank))) is not None:
            heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
    return [x for x in ids if x >= 0]


def merge_chars(text: str, scores: dict[str, float]) -> list[str]:
    """Merge neighbours whose string is an entry, by score, then from the left."""
    parts = list(text)
    n = len(parts)
    if n <= SHORT:
        none, get = -LOWEST, scores.get
        found = [-get(left + right, LOWEST) for left, right in zip(parts, parts[1:])]
        while found and (least := min(found)) < none:
            i = found.index(least)
            parts[i] += parts[i + 1]
            del parts[i + 1], found[i]
            if i < len(found):
                found[i] = -get(parts[i] + parts[i + 1], LOWEST)
            if i:
                found[i - 1] = -get(parts[i - 1] + parts[i], LOWEST)
        return parts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (s := scores.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s, i, j, len(parts[i]) + len(parts[j])))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p]
