"""Exact n-gram Jaccard self-join of documents by signature trees, spread over Spark.

1. Each text's set of word shingles is cut into parts by hash range, more parts
   than the sets of two linked texts can have differences. So linked texts agree
   in one part at least, and the hash of that part is a routing key both have.
   Sets that share a key form a group; groups of the same sets are one group.
2. In each group the sets are the leaves of a signature tree: a node holds the
   OR of its sets' token bitmaps and the range of their sizes. A dual traversal
   visits pairs of nodes, drops those whose largest possible overlap is too
   small, and those whose sets are already connected. What is left are candidate
   pairs, as a spanning forest; they connect sets to blocks.
3. In each block another such tree is joined with itself, now comparing the
   whole sets, and yields a spanning forest of links, not all links.

Groups and blocks are cut into chunks of bounded size. One of several chunks
goes through two more joins: of a few members of each part connected so far, and
of every set outside the largest connected part against all chunks. After the
second, no pair of sets that aren't connected is left uncompared. Equal sets are
one vertex from the first step on, so copies cost nothing later.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, components, join_groups, spare_name
from morphmill.llm._text import mix, shingle_sets

#: Of a chunk: its sets, and their shingles together.
CHUNK_SETS, CHUNK_SHINGLES = 4096, 4_000_000
#: Sets under one leaf, and nodes under one inner node.
FANOUT = 8
_SALT = np.uint64(0xD6E8FEB86659FD93)


# ---- routing keys -------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def class_end(c: int) -> int:
    """The first size beyond class c; the bounds of classes grow by half."""
    return 8 if c == 0 else class_end(c - 1) * 3 // 2


def differences(n: int, m: int, percent: int) -> int:
    """The most tokens in which two sets of n and m tokens can differ if 100 * intersection >= percent * union."""
    return (n + m) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def _parts(c: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of class c the bounds of its parts and their salts.

    Somewhat more parts than two of its largest sets can have differences, as some of a set's parts are empty.
    """
    most = differences(class_end(c) - 1, class_end(c) - 1, percent)
    parts = (most + 1) * 9 // 8 + 3
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return cuts, mix(np.arange(parts, dtype=np.uint64) + np.uint64(c + 1 << 40))


def routing_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set: two different sets that link have a key in common.

    In each size class a linked set can be in (the larger of two sets counts), a
    key is the hash of a part that isn't empty. A set with more such parts than
    it can differ in from a set of the class, by its own size, shares one with
    any set it links to. Of two linked sets that share none neither has, so both
    have one more key, for all such sets of a class. With hashes as tokens next
    to no set is one: parts are as many as the largest set of the class needs. A
    small set has as keys the hashes of what is left without the few tokens that
    a linked set can lack.
    """
    n = len(s)
    if n * 100 < percent * (n + 1):
        return np.zeros(0, np.uint64)
    token = mix(s)
    total = np.sum(token, dtype=np.uint64)
    lacks = n * (100 - percent) // 100
    out = []
    if lacks <= 1:
        out.append(mix(np.append(total - token, total)))
    top, c = n * 100 // percent, 0
    if top * (100 - percent) // 100 <= 1:
        return out[0]
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(token, dtype=np.uint64)))
    while class_end(c) <= n:
        c += 1
    while True:
        cuts, salts = _parts(c, percent)
        at = np.concatenate(([0], np.searchsorted(s, cuts), [n]))
        full = at[1:] > at[:-1]
        out.append(mix((running[at[1:]] - running[at[:-1]])[full] + salts[full]))
        if full.sum() <= differences(n, min(top, class_end(c) - 1), percent):
            out.append(mix(np.array([(c + 1 << 40) - 1], np.uint64)))
        c += 1
        if top < class_end(c - 1):
            return np.concatenate(out)


def _bits(sets: list[np.ndarray], width: int = 0) -> list[np.ndarray]:
    """Bitmaps of sets: a power of two of bits, of twice the set's size at least."""
    out = []
    for s in sets:
        bits = width or max(64, 1 << (2 * len(s) - 1).bit_length())
        at = np.zeros(bits, bool)
        at[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        out.append(np.packbits(at))
    return out


def _folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of different widths as rows of the smallest width, by OR of halves."""
    least = min(map(len, maps))
    rows = []
    for m in maps:
        rows.append(np.bitwise_or.reduce(m.reshape(-1, least)) if len(m) > least else m)
    return np.ascontiguousarray(np.stack(rows)).view(np.uint64)


def _features(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, keys, bits = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                h1.append(int(np.sum(mix(s), dtype=np.uint64).astype(np.int64)))
                h2.append(int(np.sum(mix(s ^ _SALT), dtype=np.uint64).astype(np.int64)))
                keys.append(routing_keys(s, percent).view(np.int64))
                bits.append(_bits([s])[0].tobytes() if len(s) else None)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))), pa.int32()), pa.array(flat, pa.int64()))
            whole = [pa.array(x, pa.int64()) for x in (n, h1, h2)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *whole, lists, pa.array(bits, pa.binary())], ["id", "n", "h1", "h2", "keys", "bits"])

    return run


# ---- the tree -----------------------------------------------------------------------------------


class _Node:
    __slots__ = ("bits", "children", "excess", "high", "low", "seen", "sets", "whole")

    def __init__(self, bits, low, high, excess, sets, children):
        self.bits, self.low, self.high, self.excess, self.sets, self.children = bits, low, high, excess, sets, children
        # whether all sets are known to be connected; if not, the number of links at which that was last looked at
        self.whole, self.seen = False, -1


def build_tree(maps: np.ndarray, size: np.ndarray, excess: np.ndarray) -> _Node:
    """Leaves of neighbouring sets, by size and bitmap; a parent ORs its children's bitmaps."""
    order = np.lexsort((maps[:, 0], np.floor(np.log2(size) * 4)))
    nodes = []
    for a in range(0, len(order), FANOUT):
        own = order[a : a + FANOUT]
        nodes.append(_Node(np.bitwise_or.reduce(maps[own]), int(size[own].min()), int(size[own].max()), int(excess[own].max()), own.tolist(), []))
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), FANOUT):
            own = nodes[a : a + FANOUT]
            above.append(_Node(np.bitwise_or.reduce([x.bits for x in own]), min(x.low for x in own), max(x.high for x in own), max(x.excess for x in own), [i for x in own for i in x.sets], own))
        nodes = above
    return nodes[0]


def may_link(a: _Node, b: _Node, percent: int) -> bool:
    """Whether some set of a and some set of b can link, by sizes and by the largest possible overlap.

    Of a set's tokens, no more than its bits in the other node's bitmap can be
    shared, besides those that fall on a bit together with another of its tokens
    (``excess``).
    """
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess)
    return (100 + percent) * most >= percent * (a.low + b.low)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def tree_links(maps: np.ndarray, size: np.ndarray, root: list[int], percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose bitmaps allow a link, or that link, if there are ``sets``.

    ``root`` has a parent for each set, by what is already connected, and is updated.
    """
    excess = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def whole(x: _Node) -> bool:
        if not x.whole and x.seen < len(links):
            x.seen = len(links)
            if x.children:
                x.whole = all(map(whole, x.children)) and len({find(y.sets[0]) for y in x.children}) == 1
            else:
                x.whole = len({find(i) for i in x.sets}) == 1
        return x.whole

    def compare(own: list[int], other: list[int], same: bool) -> None:
        p, q = np.array(own), np.array(other)
        most = np.bitwise_count(maps[p][:, None, :] & maps[q][None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(excess[p][:, None], excess[q][None, :])
        n, m = size[p][:, None], size[q][None, :]
        for i, j in np.argwhere(((100 + percent) * most >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))).tolist():
            if same and j <= i:
                continue
            i, j = own[i], other[j]
            a, b = find(i), find(j)
            if a != b and (sets is None or linked(sets[i], sets[j], percent)):
                links.append((i, j))
                root[max(a, b)] = min(a, b)

    links: list[tuple[int, int]] = []
    top = build_tree(maps, size, excess)
    stack = [(top, top)]
    while stack:
        a, b = stack.pop()
        if (whole(a) and whole(b) and find(a.sets[0]) == find(b.sets[0])) or (a is not b and not may_link(a, b, percent)):
            continue
        if not a.children and not b.children:
            compare(a.sets, b.sets, a is b)
        elif a is b:
            own = a.children
            stack += [(own[p], own[q]) for p in range(len(own)) for q in range(p + 1, len(own))][::-1]
            stack += [(x, x) for x in reversed(own)]
        elif a.children and (not b.children or len(a.sets) >= len(b.sets)):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, x) for x in b.children]
    return links


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _joined(percent: int, k: int = 0):
    """Arrow batches sorted by group to links; a group is a bounded chunk, and is whole when it is joined.

    With k, rows have texts, which are compared; else they have bitmaps.
    """

    def links_of(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) < 2:
            return []
        ids, comps, given = zip(*rows, strict=True)
        first: dict[int, int] = {}
        root = [first.setdefault(c, i) for i, c in enumerate(comps)]
        if k:
            size = np.array([len(s) for s in given])
            maps = _folded(_bits(given, max(64, 1 << (2 * int(size.max()) - 1).bit_length())))
            found = tree_links(maps, size, root, percent, given)
        else:
            found = tree_links(_folded([np.frombuffer(b, np.uint8) for _, b in given]), np.array([n for n, _ in given]), root, percent)
        return [(ids[i], ids[j]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "id", "comp")]
            given = zip(batch.column("h1").to_pylist(), shingle_sets(batch.column("text"), k), strict=True) if k else zip(batch.column("n").to_pylist(), batch.column("bits").to_pylist(), strict=True)
            links: list[tuple[int, int]] = []
            for group, rep, comp, (x, y) in zip(*columns, given, strict=True):
                if group != now:
                    links += links_of(rows)
                    now, rows = group, []
                if not k:
                    rows.append((rep, comp, (x, y)))
                elif int(np.sum(mix(y), dtype=np.uint64).astype(np.int64)) == x:  # else a row that repeats the id
                    rows.append((rep, comp, y))
            if links:
                yield _pairs(links)
        if links := links_of(rows):
            yield _pairs(links)

    return run


# ---- the join -----------------------------------------------------------------------------------


def _forest(blocks: DataFrame, payload: DataFrame, run, scratch: Scratch) -> DataFrame:
    """Links (a, b) within each block of (block, id, n, h1), by trees over what payload has of each id."""
    blocks = scratch.save(blocks, "blocks")
    total = blocks.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"), F.count("*").alias("held"))
    total = scratch.save(total, "totals")
    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("id"), F.col("chunks"))).otherwise(0)
    sized = scratch.save(join_groups(blocks, total, ["block"], "held").drop("held").withColumn("chunk", chunk), "sized")

    def join(members: DataFrame) -> DataFrame:
        # dealt by id at every size; a broadcast of a small table's members would only suit small tables
        ready = members.hint("merge").join(payload, "id").repartition("group").sortWithinPartitions("group")
        return scratch.save(ready.mapInArrow(run, "a long, b long"), "tree")

    found = [join(sized.select("id", "n", "h1", F.col("id").alias("comp"), F.xxhash64("block", "chunk").alias("group")))]
    wide = sized.where("chunks > 1")
    if wide.limit(1).count():
        for step in ("pivots", "outliers"):
            comp = components(_all(found), scratch)
            now = wide.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
            now = scratch.save(now.select("id", "n", "h1", "comp", "block", "chunk", "chunks"), step)
            if step == "pivots":
                nth = F.row_number().over(Window.partitionBy("block", "chunk", "comp").orderBy(F.xxhash64("id")))
                few = now.withColumn("nth", nth).where("nth <= 4")
                waves = few.groupBy("block").agg(F.ceil(F.count("*") / CHUNK_SETS).alias("waves"))
                few = few.join(waves, "block").withColumn("group", F.xxhash64("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("waves"))))
                found.append(join(few.select("id", "n", "h1", "comp", "group")))
                continue
            main = now.groupBy("block", "comp").count().groupBy("block").agg(F.max_by("comp", "count").alias("main"))
            outer = now.join(main, "block").where("comp <> main")
            heaps = outer.groupBy("block").agg(F.ceil(F.count("*") / (CHUNK_SETS // 4)).cast("int").alias("heaps"))
            outer = outer.join(heaps, "block").withColumn("heap", F.pmod(F.xxhash64("id", F.lit(2)), F.col("heaps")).cast("int"))
            inner = now.join(heaps, "block").withColumn("heap", F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)))
            outer = outer.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
            columns = ["id", "n", "h1", "comp", F.xxhash64("block", "chunk", "heap").alias("group")]
            found.append(join(inner.select(*columns).union(outer.select(*columns))))
    return _all(found)


def _groups(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, id) of the sets that share a key with another; keys of the same sets are one block.

    Keys that hold a large part of all rows are looked for in a sample, and are
    ten thousand at most, as each has over a ten thousandth of it. Their sums
    come from an aggregate with map-side combine and are broadcast, and their
    rows are dealt by id. Which keys these are changes where a key's rows are
    looked at, not what its block is.
    """
    held = sets.select("id", F.explode("keys").alias("key"))
    names = [F.count("*").alias("sets"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum")]
    sample = held.where("pmod(xxhash64(id), 64) = 0").groupBy("key").count()
    n = sample.agg(F.sum("count")).first()[0] or 0
    hot = scratch.save(sample.where(F.col("count") > max(64, n / 10_000)).select("key"), "often")
    if hot.limit(1).count():
        sums = scratch.save(held.join(F.broadcast(hot), "key").groupBy("key").agg(*names), "sums")
        held = held.join(F.broadcast(sums.withColumnsRenamed({"sets": "hot_sets", "sum": "hot_sum"})), "key", "left")
    else:
        held = held.withColumn("hot_sets", F.lit(None).cast("long")).withColumn("hot_sum", F.lit(None).cast("decimal(30,0)"))
    held = held.withColumn("deal", F.when(F.col("hot_sets").isNull(), F.col("key")).otherwise(F.xxhash64("id", "key")))
    key = Window.partitionBy("deal")
    found = held.withColumn("sets", F.coalesce("hot_sets", F.count("*").over(key)))
    found = found.withColumn("block", F.xxhash64(F.coalesce("hot_sum", F.sum(F.xxhash64("id").cast("decimal(20,0)")).over(key)), "sets"))
    return found.where("sets > 1").select("block", "id").distinct()


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two texts link when 100 * intersection >= percent * union of their sets of
    distinct k-word shingles (A-Z lower-cased; a text of fewer words is one
    shingle). A null or empty text, or one without words, has no shingles and its
    own id as component. Rows of equal sets are in one component. A row without
    id has n_shingles and a null component, and links nothing. Rows that repeat
    an id are returned each. Other columns are neither read nor returned. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with Scratch(spark) as scratch:
        schema = "id long, n long, h1 long, h2 long, keys array<long>, bits binary"
        featured = scratch.save(text.mapInArrow(_features(k, percent), schema), "features")
        rows = scratch.save(featured.select("id", "n", "h1", "h2"), "rows", keep=True)
        usable = featured.where("id is not null and n > 0")
        sets = usable.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.count("*").alias("held"))
        sets = scratch.save(sets, "sets")
        scratch.drop(featured)
        groups = scratch.save(_groups(sets, scratch), "groups")
        slim = sets.select("id", "n", "h1")
        maybe = _forest(groups.join(slim, "id"), sets.select("id", "bits"), _joined(percent), scratch)
        blocks = components(maybe, scratch).withColumnRenamed("component", "block")
        links = _forest(blocks.join(slim, "id"), text, _joined(percent, k), scratch)
        # a set's component, once; the rows of a set that very many have stay where they are
        of_set = sets.select("n", "h1", "h2", "id", "held").join(components(links, scratch), "id", "left")
        of_set = scratch.save(of_set.select("n", "h1", "h2", F.coalesce("component", "id").alias("component_id"), "held"), "components", keep=True)
        found = join_groups(rows.where("id is not null and n > 0"), of_set, ["n", "h1", "h2"], "held").select("id", "n", "component_id")
    # what has no words, or no id, meets nothing
    rest = rows.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_copies_removed(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for all rows of each component that don't have its smallest id; columns as they are.

    Rows without id or without words stay.
    """
    found = ngram_join(docs, k, percent, id_col, text_col)
    own = spare_name(docs, "_gone")
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(own)).distinct()
    return docs.join(gone, docs[id_col] == F.col(own), "left_anti")
