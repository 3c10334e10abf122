"""Removal of byte strings that occur more than once, by suffix arrays over chosen suffixes.

A string of ``length`` bytes is repeated if it starts anywhere else, in any text.
Sorting all suffixes of all texts is neither needed nor affordable: of every
window of that many bytes the gram with the least hash is its anchor, so equal
windows have equal anchors at equal places. A window is what lies left and right
of its anchor; all windows of an anchor are its context.

Anchors that occur once have no repeated window. Those whose contexts are equal
have nothing else. For the others one suffix of each different context is sorted
to the right of the anchor and one, reversed, to its left: deep-shallow sorting,
that is multikey quicksort to a shallow depth, then blind tries for what still is
equal there. The common prefixes of neighbours in both orders say which windows
of which contexts are equal.

Groups of more contexts than a task should sort are split by the windows they
are asked for: half of them share a longer core, whose hash divides the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, join_groups
from morphmill.llm._text import _powers, mix, slices, text_bytes

#: Bytes of an anchor, of those that a repeated string has.
GRAM = 64
#: Suffixes are sorted by multikey quicksort up to so many bytes, in characters of eight.
SHALLOW = 64
#: Bytes of text that are hashed at once, and texts that are cut at once: what bounds a task's memory.
HASHED_AT_ONCE, TEXTS_AT_ONCE = 1 << 19, 500
#: Contexts of one anchor that a task sorts; larger groups are split.
MOST_CONTEXTS = 20_000
#: Contexts that are sorted at once.
SORTED_AT_ONCE = 30_000

_rng = np.random.Generator(np.random.PCG64(77003))
_GRAM_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CONTEXT_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ANCHORS = "h long, c long, id long, t long, start int, pos int, end int, n int"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: int, hi: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors from lo to hi in neighbouring texts, given each byte's text by its ``begin`` and ``end`` (not necessarily in ``data``): place, gram hash, context start, end and hash.

    Of equal least grams in a window each is an anchor.
    """
    width, n = length - gram + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.view(np.uint64), none, none, none.view(np.uint64)
    r, inverse = _powers(n + 1)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_GRAM_BYTE[data] * r[:n], out=running[1:])
    grams = mix((running[gram:] - running[:-gram]) * inverse[: n - gram + 1]) | np.uint64(1)
    least = _sliding(grams, width, np.minimum)
    at = np.arange(len(least))
    least[(at + length > end[: len(least)]) | (at < begin[: len(least)])] = 0
    edge = np.zeros(width - 1, np.uint64)
    pos = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == grams)
    pos = pos[(pos >= lo) & (pos < hi)]
    back = np.minimum(width - 1, pos - begin[pos])
    start, stop = pos - back, np.minimum(pos + length, end[pos])
    # a window of a text's last bytes begins further left; the first of the windows ends at the latest ``length`` after the anchor
    np.cumsum(_CONTEXT_BYTE[data] * r[:n], out=running[1:])
    context = (running[stop] - running[start]) * inverse[start]
    context = mix(mix(context) + (back * length * 4 + stop - start).astype(np.uint64))
    return pos, grams[pos], start, stop, context


def _unions(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals in order of text and start, ends in order too; those that overlap or touch as one."""
    if not len(doc):
        return doc, start, end
    opens = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])))
    first = np.flatnonzero(opens)
    return doc[first], start[first], end[np.append(first[1:], len(doc)) - 1]


def anchor_batches(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(id, t, text) to ANCHORS: of equal contexts in a slice of texts one, with their number ``n``, and the spans they cover without hashes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids, keys = batch.column("id"), batch.column("t")
        for i, j in slices(offsets, HASHED_AT_ONCE):
            lo, hi = int(offsets[i]), int(offsets[j])
            sizes = np.diff(offsets[i : j + 1])
            # a longer text is read in parts; a part sees the windows of all of its anchors
            for a in range(lo, hi, HASHED_AT_ONCE) if j == i + 1 else (lo,):
                b = min(a + HASHED_AT_ONCE, hi) if j == i + 1 else hi
                x, y = max(lo, a - length), min(hi, b + length)
                if j == i + 1:
                    begin, end = np.full(y - x, lo - x), np.full(y - x, hi - x)
                    doc_of = lambda p: np.zeros(len(p), np.int64)
                else:
                    begin, end = np.repeat(offsets[i:j] - x, sizes), np.repeat(offsets[i + 1 : j + 1] - x, sizes)
                    doc_of = lambda p: np.searchsorted(offsets[i : j + 1] - x, p, "right") - 1
                pos, h, start, stop, c = anchors(data[x:y], begin, end, a - x, b - x, length, gram)
                if not len(pos):
                    continue
                doc = doc_of(pos)
                base = begin[pos]
                pos, start, stop = pos - base, start - base, stop - base
                order = np.lexsort((np.arange(len(h)), c, h))
                fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])))
                first = np.flatnonzero(fresh)
                counts = np.diff(np.append(first, len(h)))
                again = np.sort(order[np.repeat(counts > 1, counts)])
                of, s, e = _unions(doc[again], start[again], stop[again])
                one = order[first]
                row = np.concatenate((doc[one], of)) + i
                mask = np.concatenate((np.zeros(len(one), bool), np.ones(len(of), bool)))
                pad = np.zeros(len(of), np.int64)
                hashes = [pa.array(np.concatenate((v[one].view(np.int64), pad)), pa.int64(), mask=mask) for v in (h, c)]
                numbers = [np.concatenate((start[one], s)), np.concatenate((pos[one], pad)), np.concatenate((stop[one], e)), np.concatenate((counts, pad))]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*hashes, ids.take(take), keys.take(take), *(pa.array(v, pa.int32()) for v in numbers)], ["h", "c", "id", "t", "start", "pos", "end", "n"])


class BlindTrie:
    """Strings by the places where they branch: a node has a depth and children by the byte there (-1: the string ends), a leaf the numbers of equal strings.

    A string goes down by those bytes alone to some leaf, is compared with it
    once, and is put in where the two part.
    """

    def __init__(self):
        self.root = None

    def add(self, s: bytes, number: int) -> None:
        if self.root is None:
            self.root = (s, [number])
            return
        node, path = self.root, []
        while isinstance(node[1], dict):
            path.append(node)
            depth, below = node
            node = below.get(s[depth] if depth < len(s) else -1) or next(iter(below.values()))
        other, numbers = node
        if other == s:
            numbers.append(number)
            return
        least = min(len(s), len(other))
        gap = int.from_bytes(s[:least]) ^ int.from_bytes(other[:least])
        at = least - (gap.bit_length() + 7) // 8
        own, theirs = (x[at] if at < len(x) else -1 for x in (s, other))
        # the last node of the path that lies above the parting
        k = next((i for i, (depth, _) in enumerate(path) if depth >= at), len(path))
        below = path[k] if k < len(path) else node
        if k < len(path) and below[0] == at:
            below[1][own] = (s, [number])
            return
        split = (at, {theirs: below, own: (s, [number])})
        if k == 0:
            self.root = split
        else:
            depth, children = path[k - 1]
            children[s[depth] if depth < len(s) else -1] = split

    def in_order(self) -> Iterator[tuple[list[int], int]]:
        """The numbers of each string, and its common prefix with the string before (for the first, -1)."""
        stack, common = [(self.root, -1)] if self.root else [], -1
        while stack:
            node, common = stack.pop()
            if isinstance(node[1], dict):
                depth, below = node
                keys = sorted(below, reverse=True)
                stack += [(below[k], depth) for k in keys[:-1]] + [(below[keys[-1]], common)]
            else:
                yield node[1], common


def suffix_order(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings in order of group and bytes, and each one's common prefix with the one before it, -1 for the first of a group.

    ``group`` does not fall. Multikey quicksort divides all groups at once by a
    character of eight bytes: less than, equal to or above that of each part's
    middle string; equal parts go on with the next character.
    """
    n, chars = len(starts), SHALLOW // 8
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(SHALLOW)
    head = np.where(at < sizes[:, None], data[np.minimum(starts[:, None] + at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    keys = head.view(">u8").astype(np.uint64)
    order, part, depth = np.arange(n), group.astype(np.int64), np.zeros(n, np.int64)
    while True:
        first = np.flatnonzero(np.diff(part, prepend=-1))
        size = np.diff(np.append(first, n))
        active = np.flatnonzero(np.repeat(size > 1, size) & (depth < chars))
        if not len(active):
            break
        middle = np.repeat(order[first + size // 2], size)[active]
        d = depth[active]
        own, pivot = keys[order[active], d], keys[middle, d]
        side = (own >= pivot).astype(np.int64) + (own > pivot)
        rank = np.full(n, 1, np.int64)
        rank[active] = side
        step = np.zeros(n, np.int64)
        step[active] = side == 1
        places = np.argsort(part * 3 + rank, kind="stable")
        order, rank, depth, part = order[places], rank[places], (depth + step)[places], part[places]
        part = np.cumsum(np.diff(part * 3 + rank, prepend=part[0] * 3 + rank[0]) != 0)
    # what is equal up to here is put in order by a blind trie for each part
    first = np.flatnonzero(np.diff(part, prepend=-1))
    size = np.diff(np.append(first, n))
    text, inside = data.tobytes(), []
    for f, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        trie = BlindTrie()
        for m in order[f : f + k].tolist():
            s = int(starts[m])
            trie.add(text[s : s + int(sizes[m])], m)
        members, shared = [], []
        for numbers, before in trie.in_order():
            members += numbers
            shared += [before] + [int(sizes[numbers[0]])] * (len(numbers) - 1)
        order[f : f + k] = members
        inside.append((f + 1, shared[1:]))
    same = head[order[1:]] == head[order[:-1]]
    common = np.where(same.all(axis=1), SHALLOW, same.argmin(axis=1))
    lcp = np.concatenate(([-1], np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))))
    for f, shared in inside:
        lcp[f : f + len(shared)] = shared
    lcp[np.flatnonzero(np.diff(group[order], prepend=-1))] = -1
    return order, lcp


def _nearest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Each string's longest common prefix with any other of its group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], -1))
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts with ``left`` bytes before their anchors: the least and the largest distance of a repeated window's start to the anchor, between ``lo`` and ``hi``; -1 if there is none.

    All windows hold the anchor, so those between the two are covered by them.
    """
    n = len(left)
    place = offsets[:-1] + left
    right = offsets[1:] - place
    order_r, lcp_r = suffix_order(data, place, right, group)
    order_l, lcp_l = suffix_order(data[::-1].copy(), len(data) - place, left, group)
    most_r, most_l = _nearest(order_r, lcp_r), _nearest(order_l, lcp_l)
    some = (np.maximum(most_r, 0) + np.maximum(most_l, 0) >= length) & (most_r > 0)
    least, largest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not some.any():
        return least, largest
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(lo[some].min()), int(min(hi[some].max(), most_l[some].max())) + 1):
        asked = np.flatnonzero(some & (most_l >= o) & (most_r >= length - o) & (lo <= o) & (o <= hi))
        if len(asked) < 2:
            continue
        class_r[order_r] = np.cumsum(lcp_r < length - o)
        class_l[order_l] = np.cumsum(lcp_l < o)
        _, of, counts = np.unique(class_r[asked] * (n + 1) + class_l[asked], return_inverse=True, return_counts=True)
        found = asked[counts[of] > 1]
        largest[found] = o
        found = found[least[found] < 0]
        least[found] = o
    return least, largest


def sorted_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts, those of a group next to each other, to the spans of repeated windows of those that occur once."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        held = table.column("held").combine_chunks()
        offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        data = np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        start, pos, n, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "pos", "n", "lo", "hi"))
        least, largest = repeated_windows(data, offsets - offsets[0], pos - start, np.cumsum(changes(table)), lo, hi, length)
        own = np.flatnonzero((least >= 0) & (n == 1))
        take = pa.array(own)
        ids = [table.column(c).take(take).combine_chunks() for c in ("id", "t")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(pos[own] - largest[own], pa.int32()), pa.array(pos[own] - least[own] + length, pa.int32())], ["id", "t", "start", "end"])

    def changes(table: pa.Table) -> np.ndarray:
        keys = [table.column(c).to_numpy() for c in ("k1", "k2", "lo", "hi")]
        return np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(table) else np.zeros(0, bool)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= SORTED_AT_ONCE:
            table = pa.Table.from_batches(waiting)
            last = int(np.flatnonzero(changes(table))[-1])
            if last:
                yield spans(table.slice(0, last))
            waiting = table.slice(last).to_batches()
    if waiting and sum(map(len, waiting)):
        yield spans(pa.Table.from_batches(waiting))


def _split(contexts: DataFrame, scratch: Scratch, length: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts in groups (k1, k2, lo, hi) of ``most`` at most, and spans of windows found repeated on the way.

    A group's windows begin lo to hi bytes before the anchor. Halving that range
    lengthens the core that all of them share: what shares a core with nothing
    goes. Those that share all that the half's windows cover are repeated there,
    and one of them goes on for the others to be compared with. So of each
    context about one half goes on, that with the end of what it shares. A range
    of one is a window itself, which its core is all of.
    """
    whole = contexts.withColumns({"k1": F.col("h"), "k2": F.lit(0).cast("long"), "lo": F.lit(0), "hi": F.lit(length - GRAM)}).drop("h")
    small, rest, spans = whole.where(f"held_by <= {most}").drop("held_by"), whole.where(f"held_by > {most}").drop("held_by"), None
    key, own = ["k1", "k2", "lo", "hi"], ["id", "t", "start", "pos", "n", "held"]
    while rest.limit(1).count():
        middle = "cast(floor((lo + hi) / 2) as int)"
        halves = rest.selectExpr("*", f"inline(array(struct(lo as a, {middle} as b), struct({middle} + 1 as a, hi as b)))")
        # a half that asks for windows which the text hasn't is left out
        halves = halves.where(f"a <= b and a <= pos - start and b >= {length} - (octet_length(held) - (pos - start))").drop("lo", "hi").withColumnsRenamed({"a": "lo", "b": "hi"})
        core = F.expr(f"substring(held, pos - start - lo + 1, {length} - hi + lo)")
        left, right = F.expr("least(hi, pos - start)"), F.expr(f"least(octet_length(held) - (pos - start), {length} - lo)")
        covered = F.substring("held", F.col("pos") - F.col("start") - F.col("left") + 1, F.col("left") + F.col("right"))
        halves = halves.withColumns({"k1": F.xxhash64("k1", core), "k2": F.xxhash64("k2", "k1", core), "left": left, "right": right})
        halves = scratch.save(halves.withColumns({"f1": F.xxhash64("left", covered), "f2": F.xxhash64(F.lit(1), "right", covered)}), "halves")
        full = [*key, "f1", "f2"]
        same = scratch.save(halves.groupBy(*full).agg(F.count("*").alias("held_by"), F.min(F.struct(*own)).alias("of")), "covered")
        found = join_groups(halves, same.where("held_by > 1").select(*full, "held_by"), full, "held_by").where("n = 1")
        found = scratch.save(found.selectExpr("id", "t", "pos - left as start", "pos + right as end"), "repeated")
        spans = found if spans is None else spans.unionByName(found)
        # one of each; what is known to be repeated needs no answer
        one = same.where("lo < hi").select(*key, "of.*", F.when(F.col("held_by") > 1, 2).otherwise(F.col("of.n")).cast("int").alias("times")).drop("n").withColumnRenamed("times", "n")
        groups = scratch.save(one.groupBy(*key).agg(F.count("*").alias("held_by"), F.min("n").alias("least")).where("held_by > 1 and least = 1").drop("least"), "cores")
        found = scratch.save(join_groups(one, groups, key, "held_by"), "divided")
        scratch.drop(halves)
        small = small.unionByName(found.where(f"held_by <= {most}").drop("held_by"))
        rest = found.where(f"held_by > {most}").drop("held_by")
    return small, spans


def kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to the whole result; spans may overlap."""
    for batch in (whole.slice(k, TEXTS_AT_ONCE) for whole in batches for k in range(0, len(whole), TEXTS_AT_ONCE)):
        ids, sizes, digests, merged, kept = batch.column("id"), [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, runs = text.encode(), []
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if runs and s <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], e)
                else:
                    runs.append({"start": s, "end": e})
            sizes.append(len(data))
            at, parts = 0, []
            for x in runs:
                parts.append(data[at : x["start"]])
                at = x["end"]
            left = b"".join([*parts, data[at:]])
            merged.append(runs)
            kept.append(left)
            digests.append(hashlib.sha256(left).hexdigest())
        columns = [ids, pa.array(sizes, pa.int64()), pa.array(merged, pa.list_(SPAN)), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "spans", "kept_sha256", "kept"])


def _without_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kept_batches(batches):
        yield batch.select(["id", "n_bytes", "spans", "kept_sha256"])


def repeated_strings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", kept: bool = False, most: int = MOST_CONTEXTS) -> DataFrame:
    """Per row of docs: its id, ``n_bytes``, ``spans`` to remove (bytes, end exclusive, maximal), ``kept_sha256``; with ``kept``, the bytes that stay.

    Texts are read as UTF-8. A byte goes if it lies in a string of ``length``
    bytes that also starts at another place of any text; no occurrence stays.
    Strings do not cross texts. Null, empty and short texts lose nothing. Every
    row is a text: rows that repeat a text, with its id or another or none, are
    copies of one another. Other columns are neither read nor returned. An empty
    table gives an empty result. Contexts are equal if two 64-bit hashes of them
    are; sorted windows are compared by their bytes.
    """
    if length <= GRAM:
        raise ValueError(f"a repeated string has more than {GRAM} bytes")
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = text.select("id", F.xxhash64("text").alias("t"), "text")
    spot = ["id", "t", "start", "end"]
    with Scratch(spark) as scratch:
        found = scratch.save(text.mapInArrow(partial(anchor_batches, length=length, gram=GRAM), ANCHORS), "anchors")
        spans = [found.where("h is null").select(*spot)]
        found = found.where("h is not null")
        keys = found.groupBy("h").agg(F.sum("n").alias("held"), F.min("c").alias("low"), F.max("c").alias("high")).where("held > 1")
        keys = scratch.save(keys.selectExpr("h", "held", "low = high as one"), "keys")
        again = scratch.save(join_groups(found, keys, ["h"], "held").drop("held"), "again")
        spans.append(again.where("one").select(*spot))
        mixed = again.where("not one").drop("one")
        of = F.min(F.struct("id", "t", "start", "pos", "end")).alias("of")
        contexts = scratch.save(mixed.groupBy("h", "c").agg(F.sum("n").alias("n"), of), "contexts")
        equal = contexts.where("n > 1").select("h", "c", F.col("n").alias("held"))
        spans.append(join_groups(mixed, equal, ["h", "c"], "held").select(*spot))
        # one of each different context is cut out of its text
        many = contexts.groupBy("h").agg(F.count("*").alias("held_by"), F.min("n").alias("least")).where("least = 1").drop("least")
        wanted = contexts.join(many, "h").select("h", "n", "held_by", "of.*")
        wanted = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("h", "n", "held_by", "start", "pos", "end")).alias("wanted")).withColumnsRenamed({"id": "_id", "t": "_t"})
        cut = F.expr("transform(wanted, w -> struct(w.h, cast(w.n as int) as n, w.held_by, w.start, w.pos, substring(b, w.start + 1, w.end - w.start) as held))")
        own = text.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("id", "t", F.col("text").cast("binary").alias("b"), "wanted")
        held = scratch.save(own.select("id", "t", F.inline(cut)), "suffixes")
        small, done = _split(held, scratch, length, most)
        columns = ["k1", "k2", "lo", "hi", "id", "t", "start", "pos", "n", "held"]
        ready = small.select(*columns).repartition("k1", "k2", "lo").sortWithinPartitions("k1", "k2", "lo", "hi")
        spans.append(ready.mapInArrow(partial(sorted_batches, length=length), "id long, t long, start int, end int"))
        if done is not None:
            spans.append(done)
        every = spans[0]
        for more in spans[1:]:
            every = every.unionByName(more)
        every = every.groupBy("id", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"id": "_id", "t": "_t"})
        rows = text.join(every, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("id", "text", "spans")
        schema = "id long, n_bytes long, spans array<struct<start: int, end: int>>, kept_sha256 string" + (", kept binary" if kept else "")
        out = scratch.save(rows.mapInArrow(kept_batches if kept else _without_kept, schema), "kept", keep=True)
    return out.withColumnRenamed("id", id_col)
