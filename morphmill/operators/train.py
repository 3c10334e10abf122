"""Vocabulary training as Spark jobs: counts and merges run over distinct words on the executors.

The driver holds the vocabulary and, per round, a bounded list of candidates or stretches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphmill.functions.batches import SLICE, lengths
from morphmill.model import BYTE, CHAR_PAIR, NORMAL, SEQUENCE, Model, NormalizerSpec, Piece, TrainSpec, byte_pieces, layout
from morphmill.operators.segment import Unigram, cut_by_ngrams, ngram_table
from morphmill.operators.stats import byte_ngrams, char_counts, covered_chars, ngram_logprobs, word_counts, words_of
from morphmill.operators.storage import Rounds
from morphmill.sources.text import first_lines

#: Candidate pairs that a round chooses from.
CANDIDATES = 1000
#: The most frequent pairs that the driver knows the counts of; parts that the index of pairs is stored in.
KNOWN, PARTS = 100_000, 128
#: Rounds of merges that the index is behind by at most; their words are looked up by the pairs they had.
BEHIND = 48
#: Different stretches, and symbols in them, that the driver merges in a round; pairs that the first round begins with.
STRETCHES, SYMBOLS, LINKS = 50_000, 500_000, 50
#: A whole-corpus sequence is one array in one task; larger corpora are refused.
SEQUENCE_BYTES = 16 << 20
#: n-grams or pieces whose table is sent to all executors, some MB; larger tables are joined.
MOST_SENT = 500_000
#: Strings of a block, whose part of a joined table a task has.
BLOCK = 2000
LONGEST_WORD = 65_535


def stored_size(method: str, n: int, spec: TrainSpec | None = None) -> int:
    """Pieces that a model asked to have n entries stores: with special pieces and, for some methods, byte pieces."""
    metas = len((spec or TrainSpec()).meta())
    return n if method == SEQUENCE else n + metas + (256 if method in (CHAR_PAIR, "bytepiece") else 0)


def training_words(lines: DataFrame, spec: TrainSpec, normalizer: NormalizerSpec = NormalizerSpec(), han: str | None = None, max_sentences: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """(word, freq) of lines, those of ``min_count`` and more; of the first ``max_sentences`` lines that aren't empty, in an order of keys."""
    if max_sentences and not order:
        raise ValueError("the first lines of what order")
    return word_counts(words_of(first_lines(lines, max_sentences, *order), normalizer.cut, normalizer.reconstruct, han), min_count=spec.min_count)


def _flat(column: pa.ListArray) -> np.ndarray:
    """The symbols of all words of a batch, a -1 after each word."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
    return np.insert(values, ends[1:] - ends[0], -1)


def _in_lists(flat: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    """Words (t, freq) of their symbols, a -1 after each word."""
    sizes = np.diff(np.flatnonzero(flat < 0), prepend=-1) - 1
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat[flat >= 0], pa.int32()))
    return pa.RecordBatch.from_arrays([lists, pa.array(freq)], ["t", "freq"])


def _merged(flat: np.ndarray, keys: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Symbols with pairs replaced, left to right; ``keys`` are sorted, and no symbol is left in one and right in another but for a single pair of one symbol."""
    if len(flat) < 2:
        return flat
    own = (flat[:-1] << 32) + flat[1:]
    own[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
    at = np.searchsorted(keys, own)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == own)
    if not len(hit):
        return flat
    if keys[0] >> 32 == keys[0] & 0xFFFFFFFF:  # of a run of one symbol every second pair
        opens = np.diff(hit, prepend=-2) > 1
        first = hit[np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))]
        hit = hit[(hit - first) % 2 == 0]
    flat = flat.copy()
    flat[hit] = new[at[hit]]
    return np.delete(flat, hit + 1)


def _weighed(flat: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of neighbours, as numbers, and the sums of their words' freq."""
    word = np.cumsum(flat < 0)
    inside = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
    keys = (flat[inside] << 32) + flat[inside + 1]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(freq[word[inside][order]], first) if len(first) else np.zeros(0, np.int64)


def _pair_keys(flat: np.ndarray) -> np.ndarray:
    """The number of each pair of neighbours, -1 across the end of a word."""
    keys = (flat[:-1] << 32) + flat[1:]
    keys[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
    return keys


def _differences(batch: pa.RecordBatch, looked: np.ndarray, pending: list, merges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What merges change in the counts of pairs, over indexed words (pair, t, freq).

    A word is listed under each of its pairs; it counts where its smallest pair
    of those ``looked`` up leads to it.
    """
    flat = _flat(batch.column("t"))
    keys = np.append(_pair_keys(flat), -1)
    at = np.minimum(np.searchsorted(looked, keys), len(looked) - 1)
    own = np.where(looked[at] == keys, keys, np.iinfo(np.int64).max)
    ends = np.flatnonzero(flat < 0)
    least = np.minimum.reduceat(own, np.concatenate(([0], ends[:-1] + 1)))
    kept = least == batch.column("pair").to_numpy()
    flat = flat[np.repeat(kept, np.diff(ends, prepend=-1))]
    freq = batch.column("freq").to_numpy()[kept]
    for old in pending:
        flat = _merged(flat, *old)
    before, after = _weighed(flat, freq), _weighed(_merged(flat, *merges), freq)
    keys, of = np.unique(np.concatenate((before[0], after[0])), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, of, np.concatenate((-before[1], after[1])))
    return keys[sums != 0], sums[sums != 0]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (t, freq) under each different pair they have, with the pair's part; a bounded number of symbols at once."""
    for batch in batches:
        flat = _flat(batch.column("t"))
        word, keys = np.cumsum(flat < 0)[:-1], _pair_keys(flat)
        word, keys = word[keys >= 0], keys[keys >= 0]
        order = np.lexsort((keys, word))
        word, keys = word[order], keys[order]
        fresh = (np.diff(word, prepend=-1) != 0) | (np.diff(keys, prepend=-1) != 0)
        word, keys = word[fresh], keys[fresh]
        ends = np.cumsum(lengths(batch.column("t"))[0][word])
        at = 0
        while at < len(keys):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            own, rows = keys[at:last], pa.array(word[at:last])
            part = ((own >> 32) * 31 + (own & 0xFFFFFFFF)) % PARTS
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("t").take(rows), batch.column("freq").take(rows), pa.array(part, pa.int32())], ["pair", "t", "freq", "part"])
            at = last


class PairCounts:
    """Counts of pairs of symbols over words, kept up to date by what merges change.

    An index, a table in parts by pair, lists each word under each pair it has.
    A round of merges reads the parts of its pairs, and only there the words that
    hold one; the signed differences of their pairs' counts come to the driver.
    These are at most the pairs that the merged symbols have with others: four
    for each merge and symbol.

    A pair's count is largest when its younger symbol is made, and falls from
    then on. So the most frequent pairs, known to the driver, stay complete down
    to the count of the first one that was left out, ``floor``. Below that, or when the index
    is too far behind, words are written with all merges and indexed anew.
    """

    def __init__(self, words: DataFrame, rounds: Rounds):
        """Words as (t array<int>, freq long)."""
        self.rounds, self.spark = rounds, words.sparkSession
        self.words = rounds.save(words.where("size(t) > 1"))
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        #: The indexed pair that leads to each symbol younger than the index.
        self.origin: dict[int, int] = {}
        #: Of each round, the number of pairs whose counts it changed.
        self.touched: list[int] = []
        self.known, self.index = KNOWN, None
        self._index()

    def _batches(self, then, schema: str) -> DataFrame:
        pending = list(self.pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = _flat(batch.column("t"))
                for keys, new in pending:
                    flat = _merged(flat, keys, new)
                yield then(flat, batch.column("freq").to_numpy(zero_copy_only=False))

        return self.words.mapInArrow(run, schema)

    def all_pairs(self) -> DataFrame:
        """(key, cnt) of all pairs of neighbouring symbols, overlaps counted, weighted by freq."""

        def count(flat: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
            keys, sums = _weighed(flat, freq)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums, pa.int64())], ["key", "cnt"])

        return self._batches(count, "key long, cnt long").groupBy("key").agg(F.sum("cnt").alias("cnt"))

    def _index(self) -> None:
        if self.pending:

            self.words = self.rounds.save(self._batches(_in_lists, "t array<int>, freq long").where("size(t) > 1"))
        self.pending, self.origin = [], {}
        listed = self.words.mapInArrow(_listed, "pair long, t array<int>, freq long, part int")
        # a frequent pair's part is cut by its words, the more the larger the table
        cuts = 1 + self.words.count() // 500_000
        dealt = listed.repartition(F.col("part"), F.pmod(F.xxhash64("t"), F.lit(cuts))).sortWithinPartitions("part", "pair")
        self.index = self.rounds.save_parts(dealt, "part")
        best = self.all_pairs().orderBy(F.desc("cnt"), "key").limit(self.known + 1).toArrow()
        keys, counts = (best.column(c).to_numpy() for c in ("key", "cnt"))
        self.floor = int(counts[-1]) if len(keys) > self.known else 0
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].copy()

    def best(self, fits, most: int) -> list[tuple[int, int, int]]:
        """(count, l, r) of the most frequent pairs that ``fits``, ``most`` and those as frequent as the last; of pairs above the floor."""
        while True:
            at = np.flatnonzero(self.counts > self.floor)
            at = at[fits(self.keys[at] >> 32, self.keys[at] & 0xFFFFFFFF)]
            if not len(at) and self.floor:
                # with a new index, all of the known pairs are ones that don't fit
                self.known *= 1 if self.pending else 4
                self._index()
                continue
            if len(at) > most:
                at = at[self.counts[at] >= np.partition(self.counts[at], len(at) - most)[len(at) - most]]
            return [(int(self.counts[k]), int(self.keys[k] >> 32), int(self.keys[k] & 0xFFFFFFFF)) for k in at]

    def merge(self, pairs: dict[tuple[int, int], int]) -> None:
        """Pairs that can be merged at once, to their new symbols."""
        keys = np.array([(left << 32) + right for left, right in pairs], np.int64)
        order = np.argsort(keys)
        merges, pending = (keys[order], np.array(list(pairs.values()), np.int64)[order]), list(self.pending)
        led = []
        for (left, right), new in pairs.items():
            self.origin[new] = self.origin.get(left, self.origin.get(right, (left << 32) + right))
            led.append(self.origin[new])
        looked = np.unique(np.array(led, np.int64))
        parts = sorted({((k >> 32) * 31 + (k & 0xFFFFFFFF)) % PARTS for k in looked.tolist()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    found, sums = _differences(batch, looked, pending, merges)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums)], ["key", "cnt"])

        listed = self.index.where(F.col("part").isin(parts) & F.col("pair").isin(looked.tolist())).select("pair", "t", "freq")
        changes = listed.mapInArrow(run, "key long, cnt long").groupBy("key").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0").toArrow()
        self.pending.append(merges)
        self.touched.append(changes.num_rows)
        changed, sums = (changes.column(c).to_numpy() for c in ("key", "cnt"))
        own = np.minimum(np.searchsorted(self.keys, changed), len(self.keys) - 1)
        known = self.keys[own] == changed
        self.counts[own[known]] += sums[known]
        fresh = ~known & (sums > self.floor)
        keys, counts = np.concatenate((self.keys, changed[fresh])), np.concatenate((self.counts, sums[fresh]))
        kept = counts > self.floor
        keys, counts = keys[kept], counts[kept]
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        if len(self.pending) >= BEHIND or len(self.keys) > 4 * self.known:
            self._index()


def _batch(candidates: list) -> list:
    """The longest run of best candidates (count, l, r) that can be merged at once with the result of merging one by one.

    No symbol is left in one pair and right in another, so no merge takes an
    occurrence of another pair; a pair of one symbol is alone. A pair that a merge
    makes is no more frequent than some pair left outside: that of the symbol
    before it and its left one, say. Of equal counts older symbols come first.
    """
    left: set[int] = set()
    right: set[int] = set()
    out = []
    for c in candidates:
        if c[1] == c[2] or c[1] in right or c[2] in left:
            break
        left.add(c[1])
        right.add(c[2])
        out.append(c)
    return out or candidates[:1]


def train_byte_pair(words: DataFrame, spec: TrainSpec, normalizer: NormalizerSpec = NormalizerSpec(), strict: bool = True) -> Model:
    """Byte-level pair merging over (word, freq).

    Ties: the pair whose larger symbol is older, then l, then r. Pairs beyond
    ``max_piece_size`` bytes are never merged. It ends when no pair is left; with
    fewer pieces than ``vocab_size`` it raises if strict, else the model is smaller.
    """
    meta = spec.meta()
    if len(meta) + 256 > spec.vocab_size:
        raise ValueError(f"vocab_size must be {len(meta) + 256} at least")
    want = spec.vocab_size - len(meta)
    symbols = [bytes([b]) for b in range(256)]
    parts: list[tuple[bytes, bytes]] = [(b"", b"")] * 256
    with Rounds(words.sparkSession, "byte-pairs") as rounds:
        state = PairCounts(_byte_ids(words), rounds)
        while len(symbols) < want:
            sizes = np.array([len(s) for s in symbols])
            best = state.best(lambda left, right: sizes[left] + sizes[right] <= spec.max_piece_size, CANDIDATES)  # noqa: B023
            if not best:
                break
            best.sort(key=lambda c: (-c[0], max(c[1:]), c[1:]))
            pairs = {}
            for _, left, right in _batch(best)[: want - len(symbols)]:
                pairs[left, right] = len(symbols)
                parts.append((symbols[left], symbols[right]))
                symbols.append(symbols[left] + symbols[right])
            state.merge(pairs)
    learned = [Piece(s, -float(i), NORMAL, *parts[i]) for i, s in enumerate(symbols)]
    return Model(spec, normalizer, layout(meta, learned, spec.vocab_size, spec.extra_tokens, strict))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words (t, freq) as their symbols and freq, a bounded number of symbols at once."""
    for batch in batches:
        ends, at = lengths(batch.column("t"))[1], 0
        while at < len(batch):
            last = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            part = batch.slice(at, last - at)
            yield _flat(part.column("t")), part.column("freq").to_numpy(zero_copy_only=False)
            at = last


def _linked(flat: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Whether each symbol but the last and the next one are one of the pairs; these are sorted."""
    own = _pair_keys(flat)
    return links[np.minimum(np.searchsorted(links, own), len(links) - 1)] == own


def _stretches(flat: np.ndarray, freq: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    """The longest stretches of words whose neighbours all are links: their symbols, four bytes each, and their words' freq."""
    on = _linked(flat, links)
    before, after = np.append(False, on), np.append(on, False)
    at = np.flatnonzero(before | after)
    starts = np.flatnonzero((after & ~before)[at])
    ends = pa.py_buffer((np.append(starts, len(at)) * 4).astype(np.int32))
    data = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(flat[at].astype(np.int32))])
    return pa.RecordBatch.from_arrays([data, pa.array(freq[np.cumsum(flat < 0)[at[starts]]], pa.int64())], ["s", "freq"])


def _levels(merges: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merges (l, r, new) in their order as groups of sorted pairs and new symbols that can be merged at once.

    A merge comes behind those that make its symbols and those that have its
    left symbol on the right, or its right one on the left: with any other it
    can change places. A pair of one symbol is a group of its own.
    """
    made: dict[int, int] = {}
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, new in merges:
        level = 1 + max(made.get(a, 0), made.get(b, 0), right.get(a, 0), left.get(b, 0))
        made[new] = level
        left[a], right[b] = max(level, left.get(a, 0)), max(level, right.get(b, 0))
        groups.setdefault((level, new if a == b else 0), []).append(((a << 32) + b, new))
    ordered = [np.array(sorted(groups[k]), np.int64) for k in sorted(groups)]
    return [(g[:, 0].copy(), g[:, 1].copy()) for g in ordered]


def _rewritten(flat: np.ndarray, freq: np.ndarray, links: np.ndarray, groups: list) -> tuple[np.ndarray, np.ndarray]:
    """Words with groups of merges, one after another; all of them are within links, so words that have none stay."""
    ends = flat < 0
    word = np.cumsum(ends) - ends
    held = np.zeros(len(freq), bool)
    held[word[:-1][_linked(flat, links)]] = True
    own = held[word]
    some = flat[own]
    for keys, new in groups:
        some = _merged(some, keys, new)
    return np.concatenate((flat[~own], some)), np.concatenate((freq[~held], freq[held]))


class CharMerges:
    """Merges of pairs of characters by their order: count, then fewer characters, the bytes, and the older symbols.

    A round takes the best pairs, ``links``, up to some pair's place in the order,
    and the stretches of words whose neighbours all are links; equal ones are
    summed on the executors. Over these the driver merges one by one until the
    best pair is at that place or behind it. That is the result over whole
    words: a new symbol's pair with a neighbour stands where its last character
    and that neighbour stood before. If these were no link, they were at that
    place or behind it, and the new pair, no more frequent and longer, is behind
    it too; if they were one, all that they became is in stretches. Pairs passed
    over as their string was made before are links as well, whatever their place.
    """

    def __init__(self, words: DataFrame, rounds: Rounds, chars: list[str], none: int, most: int):
        """Words as (t array<int>, freq long); no pair with the symbol ``none`` or of more than ``most`` bytes is merged."""
        self.rounds, self.spark, self.none, self.most = rounds, words.sparkSession, none, most
        self.words = rounds.save(words.where("size(t) > 1").repartition(words.sparkSession.sparkContext.defaultParallelism), "words-in-symbols")
        self.strings, self.made, self.refused, self.pieces = list(chars), set(), set(), []
        self.sizes = [len(c.encode()) for c in chars]
        self.known, self.links = KNOWN, LINKS

    def _order(self, count: int, left: int, right: int) -> tuple:
        name = self.strings[left] + self.strings[right]
        return (-count, len(name), name.encode(), left, right)

    def _best(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The most frequent pairs and their counts, with the count that the others have at most."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for flat, freq in _sliced(batches):
                keys, sums = _weighed(flat, freq)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums, pa.int64())], ["key", "cnt"])

        pairs = self.words.mapInArrow(count, "key long, cnt long").groupBy("key").agg(F.sum("cnt").alias("cnt"))
        best = pairs.orderBy(F.desc("cnt"), "key").limit(self.known + 1).toArrow()
        keys, counts = (best.column(c).to_numpy() for c in ("key", "cnt"))
        return keys, counts, int(counts[-1]) if len(keys) > self.known else 0

    def _found(self, links: np.ndarray) -> DataFrame:
        """Different stretches (s, freq) of words, as a saved table."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for flat, freq in _sliced(batches):
                yield _stretches(flat, freq, links)

        return self.rounds.save(self.words.mapInArrow(cut, "s binary, freq long").groupBy("s").agg(F.sum("freq").alias("freq")), "stretches")

    def round(self, budget: int) -> bool:
        """Merges of one round, until there are ``budget`` pieces; False if no pair is left."""
        keys, counts, floor = self._best()
        left, right, sizes = keys >> 32, keys & 0xFFFFFFFF, np.array(self.sizes)
        gone = np.isin(keys, list(self.refused)) if self.refused else np.zeros(len(keys), bool)
        at = np.flatnonzero((counts > floor) & (left != self.none) & (right != self.none) & (sizes[left] + sizes[right] <= self.most) & ~gone)
        if not len(at):
            # all of the known pairs are ones that can't be merged
            self.known *= 4
            return floor > 0
        while True:
            first = at if len(at) <= self.links else at[counts[at] >= counts[at[self.links]]]
            order = sorted(self._order(int(counts[k]), int(left[k]), int(right[k])) for k in first)
            stop = order[self.links] if len(order) > self.links else (-floor, -1)
            links = np.unique(np.concatenate((np.array([(x[3] << 32) + x[4] for x in order[: self.links]], np.int64), keys[gone])))
            found = self._found(links)
            n, symbols = found.agg(F.count("*"), F.sum(F.octet_length("s")) / 4).first()
            use = max(n / STRETCHES, symbols / SYMBOLS)
            if use <= 1 or self.links == 1:
                break
            self.links = max(1, int(self.links / min(4, 2 * use)))
        merges = self._merge(found.toArrow(), stop, budget)
        self.links = max(1, int(self.links * min(4, 0.7 / max(use, 0.01))))
        if merges:
            groups = _levels(merges)

            def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for flat, freq in _sliced(batches):
                    flat, freq = _rewritten(flat, freq, links, groups)
                    yield _in_lists(flat, freq)

            self.words = self.rounds.save(self.words.mapInArrow(rewrite, "t array<int>, freq long").where("size(t) > 1"), "words-in-symbols")
        return True

    def _merge(self, found: pa.Table, stop: tuple, budget: int) -> list[tuple[int, int, int]]:
        """Merges (l, r, new) one by one over stretches (s, freq), down to a place in the order."""
        data, freq = found.column("s").combine_chunks(), found.column("freq").to_numpy()
        flat, ends = np.frombuffer(b"".join(data.to_pylist()), np.int32).astype(np.int64), lengths(data)[1] // 4
        of = np.repeat(np.arange(len(freq)), np.diff(ends))
        inside = np.flatnonzero(of[:-1] == of[1:])
        pairs = (flat[inside] << 32) + flat[inside + 1]
        order = np.argsort(pairs, kind="stable")
        first = np.flatnonzero(np.diff(pairs[order], prepend=-1))
        different = pairs[order][first].tolist()
        # where each pair's left symbol stands, or stood; what stands before and after each symbol, -1 at the ends of its stretch.
        places = dict(zip(different, np.split(inside[order], first[1:]), strict=True))
        counts = dict(zip(different, np.add.reduceat(freq[of[inside[order]]], first).tolist(), strict=True))
        before, after = np.full(len(flat), -1), np.full(len(flat), -1)
        before[inside + 1], after[inside] = inside, inside + 1
        symbols, before, after, weights = flat.tolist(), before.tolist(), after.tolist(), freq[of].tolist()
        heap = [self._order(c, k >> 32, k & 0xFFFFFFFF) for k, c in counts.items() if k not in self.refused]
        heapq.heapify(heap)
        merges = []
        while heap and len(self.pieces) < budget:
            *rank, left, right = top = heapq.heappop(heap)
            key = (left << 32) + right
            if counts[key] != -rank[0]:
                if counts[key] > 0:
                    heapq.heappush(heap, (-counts[key], *top[1:]))
                continue
            if top >= stop:
                break
            name = self.strings[left] + self.strings[right]
            if name in self.made:
                self.refused.add(key)
                continue
            new = len(self.strings)
            self.made.add(name)
            self.pieces.append(name)
            self.strings.append(name)
            self.sizes.append(self.sizes[left] + self.sizes[right])
            merges.append((left, right, new))
            fresh = set()
            for at in sorted(map(int, places.pop(key))):
                gone = after[at]
                if symbols[at] != left or gone < 0 or symbols[gone] != right:
                    continue
                prior, then, weight = before[at], after[gone], weights[at]
                counts[key] -= weight
                symbols[at], symbols[gone], after[at] = new, -1, then
                if prior >= 0:
                    counts[(symbols[prior] << 32) + left] -= weight
                    pair = (symbols[prior] << 32) + new
                    counts[pair] = counts.get(pair, 0) + weight
                    places.setdefault(pair, []).append(prior)
                    fresh.add(pair)
                if then >= 0:
                    before[then] = at
                    counts[(right << 32) + symbols[then]] -= weight
                    pair = (new << 32) + symbols[then]
                    counts[pair] = counts.get(pair, 0) + weight
                    places.setdefault(pair, []).append(at)
                    fresh.add(pair)
            for pair in fresh:
                a, b = pair >> 32, pair & 0xFFFFFFFF
                if counts[pair] > 0 and self.sizes[a] + self.sizes[b] <= self.most:
                    heapq.heappush(heap, self._order(counts[pair], a, b))
        return merges


def train_char_pair(words: DataFrame, spec: TrainSpec, normalizer: NormalizerSpec = NormalizerSpec()) -> Model:
    """Character-level pair merging over (word, freq), with byte pieces for what isn't covered.

    Ties: fewer characters, then the bytes' order. A string that was already
    made in another way is passed over and its pair never merged.
    """
    spark = words.sparkSession
    meta = dict(spec.meta())
    if len(meta) + 256 > spec.vocab_size:
        raise ValueError(f"vocab_size must be {len(meta) + 256} at least")
    for p in byte_pieces():
        meta[next(i for i in range(spec.vocab_size) if i not in meta)] = p
    unknown = chr(spec.unk_unicode)
    with Rounds(spark, "char-pairs") as rounds:
        # counts of words come from whole texts: they are made once
        words = rounds.save(words, "words")
        required = [r["char"] for r in covered_chars(char_counts(words), spec.character_coverage).orderBy(F.desc("cnt"), "char").collect()]
        budget = spec.vocab_size - len(meta) - len(required)
        chars = sorted({*required, unknown})
        own = _char_ids(words.where(F.octet_length("word") <= LONGEST_WORD), {c: i for i, c in enumerate(chars)}, chars.index(unknown))
        state = CharMerges(own, rounds, chars, chars.index(unknown), spec.max_piece_size)
        while len(state.pieces) < budget and state.round(budget):
            pass
    learned = [Piece(s.encode(), -float(i)) for i, s in enumerate([*state.pieces, *required])]
    return Model(spec, normalizer, layout(meta, learned, spec.vocab_size, spec.extra_tokens))


def _byte_ids(words: DataFrame) -> DataFrame:
    """(t, freq): words as their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column("word").cast(pa.binary()).to_pylist()), np.uint8)
            ids = pa.ListArray.from_arrays(pa.array(lengths(batch.column("word"))[1], pa.int32()), pa.array(data.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids, batch.column("freq")], ["t", "freq"])

    return words.where("word is not null").select("word", F.col("freq").cast("long").alias("freq")).mapInArrow(run, "t array<int>, freq long")


def _char_ids(words: DataFrame, ids: dict[str, int], unknown: int) -> DataFrame:
    """(t, freq): words as numbers of their characters; the alphabet is broadcast."""
    held = words.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = held.value
            own = [[table.get(c, unknown) for c in w] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column("freq")], ["t", "freq"])

    return words.select("word", F.col("freq").cast("long").alias("freq")).mapInArrow(run, "t array<int>, freq long")


def _counted(pieces: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pieces, counts], ["piece", "cnt"])


def _cut_under_ngrams(strings: pa.Array, counts: pa.Array, keys: np.ndarray, logps: np.ndarray) -> pa.RecordBatch:
    pieces, of = cut_by_ngrams(strings.cast(pa.binary()), keys, logps)
    return _counted(pieces, counts.take(pa.array(of)))


def _cut_under_pieces(strings: pa.Array, counts: pa.Array, model: Unigram) -> pa.RecordBatch:
    pieces, cnts = [], []
    for p, c in zip(strings.to_pylist(), counts.to_pylist(), strict=True):
        own = model.cut(p)
        pieces += own
        cnts += [c] * len(own)
    return _counted(pa.array(pieces, pa.binary()), pa.array(cnts, pa.int64()))


def _cut_by_join(strings: DataFrame, table: DataFrame, cut) -> DataFrame:
    """(piece, cnt) of strings (s binary, cnt) under a table (entry binary, weight) of any size.

    Strings are dealt to blocks of some thousand. The different substrings of a
    block, as long as entries can be, are joined with the table, so a task that
    cuts a block has what its lattices can use, and no more.
    ``cut`` gets strings, counts, entries and weights of a block as Arrow arrays.
    """
    n, longest = strings.count(), table.agg(F.max(F.octet_length("entry"))).first()[0] or 0
    blocked = strings.withColumn("block", F.pmod(F.xxhash64("s"), F.lit(1 + n // BLOCK)))
    parts = F.expr(f"flatten(transform(sequence(1, octet_length(s)), i -> transform(sequence(1, least({longest}, octet_length(s) - i + 1)), k -> substring(s, i, k))))")
    asked = blocked.where("octet_length(s) > 0").select("block", F.explode(F.array_distinct(parts)).alias("entry")).distinct()
    found = asked.join(table, "entry").select(F.col("block").alias("of"), "entry", "weight")

    def run(given: pa.Table, own: pa.Table) -> pa.Table:
        columns = [own.column(c).combine_chunks() for c in ("entry", "weight")]
        return pa.Table.from_batches([cut(given.column("s").combine_chunks(), given.column("cnt").combine_chunks(), *columns)])

    return blocked.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, "piece binary, cnt long")


def _summed(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("piece").agg(F.sum("cnt").alias("cnt"))


def ngram_segments(words: DataFrame, min_count: int = 1, most_sent: int | None = None) -> DataFrame:
    """(piece, cnt): pieces of distinct words under the byte n-gram model of the same words, weighted by freq.

    A model of ``most_sent`` n-grams at most is broadcast; a larger one is joined with
    the n-grams of words, and no table of it comes to the driver.
    """
    spark = words.sparkSession
    with Rounds(spark, "n-grams") as rounds:
        words = rounds.save(words, "words")
        table = rounds.save(ngram_logprobs(byte_ngrams(words), min_count).select(F.unhex("gram").alias("entry"), F.col("logp").alias("weight")))
        strings = words.select(F.encode("word", "UTF-8").alias("s"), F.col("freq").alias("cnt"))
        if table.count() > (MOST_SENT if most_sent is None else most_sent):
            cut = _cut_by_join(strings, table, lambda s, n, entries, weights: _cut_under_ngrams(s, n, *ngram_table(entries, weights)))
        else:
            rows = table.toArrow()
            held = spark.sparkContext.broadcast(ngram_table(rows.column("entry").combine_chunks(), rows.column("weight").combine_chunks()))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _cut_under_ngrams(*batch.columns, *held.value)

            cut = strings.mapInArrow(run, "piece binary, cnt long")
        out = rounds.save(_summed(cut), "pieces")
        return rounds.keep(out, "pieces")


def _resegmented(kept: DataFrame, counts: DataFrame, most_sent: int | None = None) -> DataFrame:
    """Pieces of the strings in ``counts`` under the Unigram model of ``kept``, both (piece, cnt) as saved."""
    n, total = kept.agg(F.count("*"), F.sum("cnt")).first()
    if n > (MOST_SENT if most_sent is None else most_sent):
        strings, table = counts.select(F.col("piece").alias("s"), "cnt"), kept.select(F.col("piece").alias("entry"), F.col("cnt").alias("weight"))
        return _summed(_cut_by_join(strings, table, lambda s, c, entries, weights: _cut_under_pieces(s, c, Unigram(dict(zip(entries.to_pylist(), weights.to_pylist(), strict=True)), total=total))))
    rows = kept.select("piece", "cnt").toArrow()
    held = counts.sparkSession.sparkContext.broadcast(dict(zip(rows.column("piece").to_pylist(), rows.column("cnt").to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(held.value)
        for batch in batches:
            yield _cut_under_pieces(*batch.columns, model)

    return _summed(counts.select("piece", "cnt").mapInArrow(run, "piece binary, cnt long"))


def prune_pieces(counts: DataFrame, spec: TrainSpec, slots: int, most_sent: int | None = None) -> list[tuple[bytes, int]]:
    """Pieces short and frequent enough; the others are cut into those and counted again, until the set stays the same.

    Of more than ``slots`` pieces single bytes come first, then count, length and
    bytes decide; these come to the driver. Each step is a saved table. A model of
    ``most_sent`` pieces at most is broadcast, a larger one joined.
    """
    short = (F.octet_length("piece") <= spec.max_piece_size) & (F.col("cnt") >= spec.min_count)
    with Rounds(counts.sparkSession, "pieces") as rounds:
        counts = rounds.save(counts, "counts")
        kept = rounds.save(counts.where(short), "kept")
        again = _resegmented(kept, counts.where(~short), most_sent)
        kept = rounds.save(_summed(kept.unionByName(again)), "kept")
        while True:
            n = kept.count()
            kept = rounds.save(_resegmented(kept, kept, most_sent), "kept")
            if kept.count() == n:
                break
        order = [F.octet_length("piece") > 1, F.desc("cnt"), F.desc(F.octet_length("piece")), F.col("piece")]
        return [(bytes(r["piece"]), r["cnt"]) for r in kept.orderBy(*order).limit(max(slots, 0)).collect()]


def train_ngram(words: DataFrame, spec: TrainSpec, normalizer: NormalizerSpec = NormalizerSpec(), most_sent: int | None = None) -> Model:
    """Byte n-gram language model, Viterbi pieces, pruning; scores are counts. ``words`` are unfiltered (word, freq)."""
    meta = dict(spec.meta())
    for p in byte_pieces():
        meta[len(meta)] = p
    if len(meta) > spec.vocab_size:
        raise ValueError(f"vocab_size must be {len(meta)} at least")
    pieces = prune_pieces(ngram_segments(words, spec.min_count, most_sent), spec, spec.vocab_size - len(meta), most_sent)
    learned = [Piece(p, float(c)) for p, c in sorted(pieces, key=lambda x: (-x[1], x[0]))]
    own = layout(meta, learned, spec.vocab_size, spec.extra_tokens)
    return Model(replace(spec, vocab_size=len(own)), normalizer, own)


def train_sequence(lines: DataFrame, spec: TrainSpec, *order: str) -> Model:
    """Byte pair merging over all lines as one sequence, which pairs may cross; for small corpora only.

    Ties: the pair that occurs first. It ends when no pair occurs twice.
    """
    some = lines.where("line <> ''")
    size = some.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
    if size > SEQUENCE_BYTES:
        raise ValueError(f"{size} bytes; a sequence of {SEQUENCE_BYTES} at most is trained on")
    merges = spec.vocab_size - 256
    if merges <= 0:
        raise ValueError("vocab_size must be 257 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = b"".join(x.encode() + b"\n" for batch in batches for x in batch.column(0).to_pylist())
        ids, left, right = np.frombuffer(text, np.uint8).astype(np.int64), [], []
        for new in range(256, 256 + merges):
            if len(ids) < 2:
                break
            key = (ids[:-1] << 32) + ids[1:]
            found, first, counts = np.unique(key, return_index=True, return_counts=True)
            top = counts.max()
            if top <= 1:
                break
            best = found[counts == top][first[counts == top].argmin()]
            at = np.flatnonzero(key == best)
            if best >> 32 == best & 0xFFFFFFFF:  # overlaps: every second of a run
                starts = np.concatenate(([True], np.diff(at) > 1))
                run_start = at[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]
                at = at[(at - run_start) % 2 == 0]
            ids[at] = new
            ids = np.delete(ids, at + 1)
            left.append(int(best >> 32))
            right.append(int(best & 0xFFFFFFFF))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(left)), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32())], ["n", "l", "r"])

    one = some.orderBy(*order).select("line").coalesce(1)
    symbols, learned = [bytes([b]) for b in range(256)], []
    for r in sorted(one.mapInArrow(run, "n int, l int, r int").collect()):
        u, v = symbols[r["l"]], symbols[r["r"]]
        symbols.append(u + v)
        learned.append(Piece(u + v, -float(r["n"]), NORMAL, u, v))
    return Model(spec, NormalizerSpec(space=""), tuple(Piece(bytes([b]), 0.0, BYTE) for b in range(256)) + tuple(learned))
