"""How the sources of a language differ in their terms, by mergeable radix tries.

Each task counts the terms of its texts in a byte trie whose leaves have counters
for each language and source. A trie is held by its leaves in the order of their
bytes: each has the depth where its path leaves that of the leaf before, and the
label from there on. Tries are cut into sub-tries by their first bytes, dealt by
ranges of (language, prefix) and merged there, which says what terms are in
documents enough. The kept ones go once more through each range in UTF-8 order:
sums over pairs of sources and the first candidates of each source leave a range,
and are added up or ranked over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch
from morphmill.llm._text import lower, slices, text_bytes, word_bounds

#: Bytes of text whose terms are counted together; leaves and counters of a trie that is full.
TEXT_AT_ONCE, MOST_LEAVES, MOST_COUNTERS = 4 << 20, 300_000, 1_000_000
#: Bytes that all leaves of a sub-trie share, or are.
PREFIX = 3
#: Sub-tries and terms of a batch that leaves a task; terms that are compared at once.
ROWS, TERMS_AT_ONCE = 2000, 1024
#: Sources of a language that are compared in one table; more are compared by pairs of such tiles.
TILE = 256
UNIT, SMOOTH = 1_000_000_000, 5

_GAP = np.ones(256, bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
#: A sub-trie; of each leaf ``shared`` (0 for the first), its label's bytes, documents and number of counters.
TRIES = "lang string, prefix binary, shared array<int>, sizes array<int>, labels binary, docs array<long>, counters array<int>, keys array<long>, counts array<long>"
LEAVES = "lang string, term string, docs long, keys array<long>, counts array<long>"


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of byte strings."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _byte_strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Neighbouring strings of these sizes."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _inside(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all elements of runs."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def shared_prefixes(terms: pa.Array) -> np.ndarray:
    """The number of bytes that each string shares with the one before; 0 for the first."""
    data, offsets = _strings(terms)
    out = np.zeros(len(terms), np.int64)
    if len(terms) < 2:
        return out
    # eight bytes from any place, the first one the highest
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    least = np.minimum(np.diff(offsets)[1:], np.diff(offsets)[:-1])
    active, depth = np.flatnonzero(least > 0), 0
    while len(active):
        differ = (words[offsets[active + 1] + depth] ^ words[offsets[active] + depth]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        out[active + 1] = np.minimum(depth + same, least[active])
        depth += 8
        active = active[(same == 8) & (least[active] > depth)]
    return out


class SourceTrie:
    """Terms with counters (occurrences, documents) by group; a group is a language and a source."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[int, int], int] = {}
        # terms, and counters as (leaf, group, occurrences, documents)
        self.parts: list[tuple[pa.Array, np.ndarray]] = []
        self.size = self.held = self.packed = 0

    def group_of(self, langs: pa.Array, keys: pa.Array) -> np.ndarray:
        """The group number of each (language, source key)."""
        langs, keys = langs.dictionary_encode(), keys.dictionary_encode()
        own = [self.langs.setdefault(x, len(self.langs)) for x in langs.dictionary.to_pylist()]
        wide = max(1, len(keys.dictionary))
        pairs, of = np.unique(langs.indices.to_numpy().astype(np.int64) * wide + keys.indices.to_numpy(), return_inverse=True)
        named = keys.dictionary.to_pylist()
        number = [self.groups.setdefault((own[p // wide], named[p % wide]), len(self.groups)) for p in pairs.tolist()]
        return np.array(number, np.int64)[of]

    def add(self, terms: pa.Array, leaf: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray) -> None:
        """Counters of ``terms``, which leaf numbers; terms may be in the trie already."""
        table = _summed(np.stack((leaf, group, count, docs)))
        self.parts.append((terms, table))
        self.held += table.shape[1] + len(terms)
        if self.held > 2 * self.packed + MOST_COUNTERS // 4:
            self._pack()

    def _pack(self) -> None:
        """Each term once, and each counter once."""
        if len(self.parts) > 1:
            coded = pa.concat_arrays([t for t, _ in self.parts]).dictionary_encode()
            number, at, tables = coded.indices.to_numpy(), 0, []
            for terms, table in self.parts:
                table[0] = number[table[0] + at]
                at += len(terms)
                tables.append(table)
            self.parts = [(coded.dictionary, _summed(np.concatenate(tables, axis=1)))]
        if self.parts:
            self.size = len(self.parts[0][0])
            self.held = self.packed = self.parts[0][1].shape[1] + self.size

    def full(self) -> bool:
        return self.size > MOST_LEAVES or self.packed > MOST_COUNTERS

    def _in_order(self, least: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By language and the bytes of terms: languages, terms, documents, numbers of counters, keys, counts; what is in ``least`` documents."""
        self._pack()
        terms, (leaf, group, count, docs) = self.parts[0]
        order = pc.sort_indices(terms)
        rank = np.empty(len(terms), np.int64)
        rank[order.to_numpy()] = np.arange(len(terms))
        lang_of, key_of = (np.array([x[i] for x in self.groups], np.int64) for i in (0, 1))
        leaf, lang = rank[leaf], lang_of[group]
        by = np.lexsort((leaf, lang))
        leaf, lang, key, count, docs = (x[by] for x in (leaf, lang, key_of[group], count, docs))
        first = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(leaf, prepend=-1) != 0))
        sizes, sums = np.diff(np.append(first, len(leaf))), np.add.reduceat(docs, first)
        kept = sums >= least
        wanted = np.repeat(kept, sizes)
        first, sizes, sums = first[kept], sizes[kept], sums[kept]
        return lang[first], terms.take(order.take(pa.array(leaf[first]))), sums, sizes, key[wanted], count[wanted]

    def tries(self) -> Iterator[pa.RecordBatch]:
        """TRIES: the trie, cut where leaves have fewer than PREFIX bytes in common."""
        if not self.parts:
            return
        lang, terms, docs, counters, key, count = self._in_order(1)
        data, offsets = _strings(terms)
        shared = shared_prefixes(terms)
        opens = (shared < PREFIX) | (np.diff(lang, prepend=-1) != 0)
        shared[opens] = 0
        sizes = np.diff(offsets) - shared
        labels = data[_inside(offsets[:-1] + shared, sizes)]
        names = pa.array(list(self.langs), pa.string())
        first = np.append(np.flatnonzero(opens), len(shared))
        label_at, counter_at = (np.concatenate(([0], np.cumsum(x))) for x in (sizes, counters))
        for k in range(0, len(first) - 1, ROWS):
            edge = first[k : k + ROWS + 1]
            a, b = edge[0], edge[-1]
            ends, held = pa.array(edge - a, pa.int32()), pa.array(counter_at[edge] - counter_at[a], pa.int32())
            own, of = slice(a, b), slice(counter_at[a], counter_at[b])
            start = offsets[edge[:-1]]
            size = np.minimum(PREFIX, offsets[edge[:-1] + 1] - start)
            columns = [
                names.take(pa.array(lang[edge[:-1]])), _byte_strings(data[_inside(start, size)], size), *(pa.ListArray.from_arrays(ends, pa.array(x[own], pa.int32())) for x in (shared, sizes)),
                _byte_strings(labels[label_at[a] : label_at[b]], np.diff(label_at[edge])), pa.ListArray.from_arrays(ends, pa.array(docs[own], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(counters[own], pa.int32())),
                *(pa.ListArray.from_arrays(held, pa.array(x[of], pa.int64())) for x in (key, count)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TRIES.split(", ")])

    def leaves(self, least: int) -> Iterator[pa.RecordBatch]:
        """LEAVES that are in ``least`` documents."""
        if not self.parts:
            return
        lang, terms, docs, counters, key, count = self._in_order(least)
        names, at = pa.array(list(self.langs), pa.string()), np.concatenate(([0], np.cumsum(counters)))
        for k in range(0, len(lang), ROWS):
            own, of = slice(k, k + ROWS), slice(at[k], at[min(k + ROWS, len(lang))])
            ends = pa.array(at[k : k + ROWS + 1] - at[k], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[of], pa.int64())) for x in (key, count)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[own])), terms[own].cast(pa.string()), pa.array(docs[own]), *lists], ["lang", "term", "docs", "keys", "counts"])


def _summed(table: np.ndarray) -> np.ndarray:
    """Counters of one leaf and group as one."""
    table = table[:, np.lexsort((table[1], table[0]))]
    first = np.flatnonzero(np.any(np.diff(table[:2], axis=1, prepend=-1) != 0, axis=0))
    return np.concatenate((table[:2, first], np.add.reduceat(table[2:], first, axis=1))) if len(first) else table


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, text) to TRIES."""
    trie = SourceTrie()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        group = trie.group_of(batch.column("lang"), batch.column("key"))
        for i, j in slices(offsets, TEXT_AT_ONCE):
            own = lower(data[offsets[i] : offsets[j]])
            starts, ends, doc = word_bounds(own, offsets[i : j + 1] - offsets[i], _GAP)
            if not len(starts):
                continue
            coded = _byte_strings(own[~_GAP[own]], ends - starts).dictionary_encode()
            leaf = coded.indices.to_numpy()
            order = np.argsort(leaf, kind="stable")
            # of a term its texts are in order, so what is of one text is together
            leaf, doc = leaf[order].astype(np.int64), doc[order]
            opens = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (doc[1:] != doc[:-1]))))
            count = np.diff(np.append(opens, len(doc)))
            trie.add(coded.dictionary, leaf[opens], group[i + doc[opens]], count, np.ones(len(opens), np.int64))
            if trie.full():
                yield from trie.tries()
                trie = SourceTrie()
                group = trie.group_of(batch.column("lang"), batch.column("key"))
    yield from trie.tries()


def merge_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """TRIES in order of language and prefix to LEAVES in ``least`` documents, with the range they are of.

    Sub-tries of a prefix are merged as a whole; with a full trie, a new one begins at the next prefix.
    """
    at = TaskContext.get().partitionId() if TaskContext.get() else 0
    trie, last = SourceTrie(), None

    def add(batch: pa.RecordBatch) -> None:
        shared, sizes, counters = (batch.column(c).flatten().to_numpy().tolist() for c in ("shared", "sizes", "counters"))
        data, offsets = _strings(batch.column("labels"))
        text, a, before, terms = data[offsets[0] : offsets[-1]].tobytes(), 0, b"", []
        for k, n in zip(shared, sizes, strict=True):
            before = before[:k] + text[a : a + n]
            terms.append(before)
            a += n
        coded = pa.array(terms, pa.binary()).dictionary_encode()
        keys, held = batch.column("keys"), np.array(counters, np.int64)
        row = np.repeat(np.arange(len(batch)), np.diff(keys.offsets.to_numpy()))
        group = trie.group_of(batch.column("lang").take(pa.array(row)), keys.flatten())
        docs = np.zeros(len(row), np.int64)
        docs[np.cumsum(held) - held] = batch.column("docs").flatten().to_numpy()
        trie.add(coded.dictionary, np.repeat(coded.indices.to_numpy(), held).astype(np.int64), group, batch.column("counts").flatten().to_numpy(), docs)

    def rows() -> Iterator[pa.RecordBatch]:
        for out in trie.leaves(least):
            yield out.append_column("range", pa.array(np.full(len(out), at, np.int32)))

    for whole in batches:
        for k in range(0, len(whole), ROWS):
            batch = whole.slice(k, ROWS)
            names = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "prefix")), strict=True))
            if trie.full():
                # what is left of the prefix that the trie ends with goes in before it is taken apart
                cut = next((x for x, name in enumerate(names) if name != last), None)
                if cut is not None:
                    if cut:
                        add(batch.slice(0, cut))
                    yield from rows()
                    trie, batch = SourceTrie(), batch.slice(cut)
            last = names[-1]
            add(batch)
    yield from rows()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / total), exactly: three digits of the quotient at a time."""
    wide = total.size and int(total.max()) >= 9 * 10**15
    left, out = (count.astype(object) if wide else count) + SMOOTH, 0
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return 1 + out


def compare_batches(batches: Iterator[pa.RecordBatch], ranks: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range, tile pair by tile pair, first its sources and then its terms in order, to parts of sums and candidates.

    (lang, part, key, other, item, value): of a ``pair`` the sum over the range's terms, of a ``term`` the first ``ranks`` of the range.
    """
    names = ["lang", "part", "key", "other", "item", "value"]

    def finished(state: dict) -> Iterator[pa.RecordBatch]:
        block(state)
        a, b, sums = state["a"], state["b"], state["sums"]
        x, y = np.divmod(np.arange(sums.size), max(1, len(b)))
        n = sums.size
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([state["lang"]] * n, pa.string()), pa.array(["pair"] * n), pa.array(a[x]), pa.array(b[y]), pa.array([None] * n, pa.string()), pa.array(sums.ravel().astype(np.int64))], names)
        tops = [(k, v, t) for k, top in zip(a.tolist(), state["tops"], strict=True) for v, t in top]
        if tops:
            n = len(tops)
            yield pa.RecordBatch.from_arrays([pa.array([state["lang"]] * n, pa.string()), pa.array(["term"] * n), pa.array([x[0] for x in tops], pa.int64()), pa.nulls(n, pa.int64()), pa.array([x[2] for x in tops]), pa.array([int(x[1]) for x in tops], pa.int64())], names)

    def block(state: dict) -> None:
        """The terms that wait, as a table by source."""
        waiting, state["waiting"], state["rows"] = state["waiting"], [], 0
        if not waiting:
            return
        table = pa.Table.from_batches(waiting)
        keys, counts = (table.column(c).combine_chunks() for c in ("keys", "counts"))
        sizes = np.diff(keys.offsets.to_numpy())
        row, of, n = np.repeat(np.arange(len(table)), sizes), keys.flatten().to_numpy(), counts.flatten().to_numpy()

        def dense(own: np.ndarray) -> np.ndarray:
            out = np.zeros((len(table), len(own)), np.int64)
            at = np.minimum(np.searchsorted(own, of), len(own) - 1)
            hit = own[at] == of
            out[row[hit], at[hit]] = n[hit]
            return out

        count = dense(state["a"])
        p = shares(count, state["n_a"])
        q = p if state["one"] else shares(dense(state["b"]), state["n_b"])
        for x in range(len(state["a"])):
            state["sums"][x] += np.abs(p[:, x : x + 1] - q).sum(axis=0)
        if not state["one"]:
            return
        every = shares(np.add.reduceat(n, np.cumsum(sizes) - sizes), state["n_lang"])
        terms = table.column("term").combine_chunks()
        for x, top in enumerate(state["tops"]):
            gain = p[:, x] - every
            good = np.flatnonzero((count[:, x] > 0) & (gain > 0))
            best = good[np.argsort(-gain[good], kind="stable")][:ranks]
            # both are in order, and terms that came before are smaller
            state["tops"][x] = sorted(top + [(gain[k], terms[int(k)].as_py()) for k in best], key=lambda t: -t[0])[:ranks]

    state: dict | None = None
    for batch in batches:
        heads = np.flatnonzero(batch.column("head").to_numpy(zero_copy_only=False))
        cuts = [0, *heads.tolist(), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo in heads:
                if state:
                    yield from finished(state)
                one = batch.slice(lo, 1).to_pylist()[0]
                a, b = ({x["key"]: x["n"] + SMOOTH * one["v"] for x in one[side]} for side in ("a", "b"))
                tile = [np.array(sorted(x), np.int64) for x in (a, b)]
                totals = [np.array([x[k] for k in keys.tolist()], np.int64) for x, keys in zip((a, b), tile, strict=True)]
                state = {
                    "lang": one["lang"], "one": one["ta"] == one["tb"], "a": tile[0], "b": tile[1], "n_a": totals[0], "n_b": totals[1],
                    "n_lang": np.array(one["n_lang"] + SMOOTH * one["v"]), "sums": np.zeros((len(tile[0]), len(tile[1])), np.int64), "tops": [[] for _ in tile[0]], "waiting": [], "rows": 0,
                }
                lo += 1
            for k in range(lo, hi, TERMS_AT_ONCE):
                state["waiting"].append(batch.slice(k, min(TERMS_AT_ONCE, hi - k)))
                state["rows"] += min(TERMS_AT_ONCE, hi - k)
                if state["rows"] >= TERMS_AT_ONCE:
                    block(state)
    if state:
        yield from finished(state)


def _keyed(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Texts with a number for their source, and the (lang, source, key) that occur; no two sources of a language have one number."""
    groups = scratch.save(own.select("lang", "source").distinct(), "groups")
    for salt in range(16):
        key = F.xxhash64(F.lit(salt), "source")
        if not groups.groupBy("lang", key.alias("key")).count().where("count > 1").limit(1).count():
            return own.withColumn("key", key), groups.withColumn("key", key)
    raise RuntimeError("sources have no different numbers")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source's terms are from the others' and from all of its language.

    Terms are runs of letters A-Z, a-z and of characters beyond ASCII, A-Z
    lower-cased. A language keeps the terms of ``least_docs`` documents or more.
    A source's share p of a term is 1 + floor(UNIT * (count + SMOOTH) / (all
    counts + SMOOTH * terms)). ``pair``: the sum of |p - q| over all kept terms,
    for each other source. ``term``: the ``ranks`` terms with the largest p - q
    above 0, q being the language's, among those that the source has. Of equal
    values the smaller item in UTF-8 comes first.

    Every row is a document, also those that repeat an id or a text. Null texts,
    languages and sources are ''. Texts without terms still make their source
    occur. Ids and other columns are not read. An empty table gives an empty
    result. Sums and counts are of 64 bits, quotients are exact.
    """
    strings = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    with Scratch(docs.sparkSession) as scratch:
        own, groups = _keyed(docs.select(*strings), scratch)
        tries = scratch.save(own.select("lang", "key", "text").mapInArrow(count_batches, TRIES), "tries")
        dealt = tries.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
        kept = scratch.save(dealt.mapInArrow(partial(merge_batches, least=least_docs), LEAVES + ", range int"), "kept")
        sizes = kept.select("lang", F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy("lang", F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n"))
        of_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"))
        terms = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("n_lang"))
        tile = F.pmod(F.xxhash64("key"), F.ceil(F.col("sources") / TILE)).cast("int")
        numbered = groups.join(sizes, ["lang", "key"], "left").join(terms, "lang", "left").join(of_lang, "lang")
        numbered = numbered.select("lang", "source", "key", tile.alias("tile"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "n_lang")))
        numbered = scratch.save(numbered, "numbered")
        # a tile is a few hundred sources; each pair of tiles of a language goes through all of its ranges
        tiles = numbered.where("v > 0").groupBy("lang", "tile").agg(F.collect_list(F.struct("key", "n")).alias("of"), F.max("v").alias("v"), F.max("n_lang").alias("n_lang"))
        other = tiles.select("lang", F.col("tile").alias("tb"), F.col("of").alias("b"))
        pairs = scratch.save(tiles.withColumnsRenamed({"tile": "ta", "of": "a"}).join(other, "lang").where("ta <= tb"), "tiles")
        heads = kept.select("lang", "range").distinct().join(pairs, "lang").select("lang", "range", "ta", "tb", F.lit(True).alias("head"), "a", "b", "v", "n_lang")
        asked = kept.join(pairs.select("lang", "ta", "tb"), "lang").select("lang", "range", "ta", "tb", F.lit(False).alias("head"), "term", "keys", "counts")
        rows = heads.unionByName(asked, allowMissingColumns=True).repartition("lang", "range", "ta", "tb").sortWithinPartitions("lang", "range", "ta", "tb", F.desc("head"), "term")
        found = rows.mapInArrow(partial(compare_batches, ranks=ranks), "lang string, part string, key long, other long, item string, value long")
        found = scratch.save(found, "found")
        # the first of each range to the first of all
        first = Window.partitionBy("lang", "key").orderBy(F.desc("value"), "item")
        best = found.where("part = 'term'").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ranks)
        best = best.join(numbered, ["lang", "key"]).select("lang", "source", "part", "item", "value", "rank")
        sums = found.where("part = 'pair'").groupBy("lang", "key", "other").agg(F.sum("value").alias("value"))
        # of two tiles one order was summed
        sums = sums.union(sums.join(numbered.select("lang", "key", F.col("tile").alias("ta")), ["lang", "key"]).join(numbered.select("lang", F.col("key").alias("other"), F.col("tile").alias("tb")), ["lang", "other"]).where("ta <> tb").select("lang", "other", "key", "value"))
        left, right = numbered.select("lang", "source", "key"), numbered.select("lang", F.col("source").alias("item"), F.col("key").alias("other"))
        every = left.join(right, "lang").where("key <> other").join(sums, ["lang", "key", "other"], "left")
        every = every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
        out = scratch.save(every.unionByName(best), "divergence", keep=True)
    return out
