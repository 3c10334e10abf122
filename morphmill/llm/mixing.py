"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold
them. A flow routes words from patterns to the sources' quotas; the first use of
a pattern's words is free, each repetition costs more than the one before, so
words repeat only where quotas ask for it and the cheapest first. Documents of a
pattern are then taken in a seeded order up to the words the flow asks for.

The flow's network has a node per pattern and source and is solved on the
driver; the number of patterns is bounded by a parameter and checked before.
Documents never leave the executors. Tables of one source a row have trivial
networks, an arc for each source.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from morphmill.llm._shared import Scratch, spare_name

#: Parts of the seeded order, at least, and rows that one part more is made for; all but one per pattern are taken or left whole.
LEAST_PARTS, PART_ROWS = 1024, 50_000

_WORD_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; a null has none."""
    edges = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(F.split(text, _WORD_GAP, -1)) - edges).otherwise(0).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words each source shall give: ``share`` times all words, by weights that repeat over the sorted sources.

    A target stops at ``most`` times its source's size; what is above is shared
    again by weight among the others, until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def min_cost_flow(capacity: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[list[int]]:
    """Words routed from each pattern to each of its sources: the most in all, and of those the cheapest.

    A pattern's words can be used ``repeats`` times, at cost 0, 1, 2, ... Each
    phase finds the distances by cost and then sends all that fits along paths of
    the least cost at once, by blocking flows. The cost of a path only rises and
    is a small number, so there are few phases, whatever the number of patterns.
    """
    n, m = len(capacity), len(quotas)
    start, end = 0, n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, most: int, price: int) -> None:
        # an arc and the one that takes its flow back are neighbours
        for x, y, r, c in ((u, v, most, price), (v, u, 0, -price)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)

    for p in range(n):
        for r in range(repeats):
            arc(start, 1 + p, capacity[p], r)
    routes = len(to)
    for p in range(n):
        for s in members[p]:
            arc(1 + p, 1 + n + s, sum(quotas), 0)
    for s in range(m):
        arc(1 + n + s, end, quotas[s], 0)
    potential = [0] * len(arcs)
    while True:
        far: list[float] = [math.inf] * len(arcs)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in arcs[u]:
                if room[e] and (now := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = now
                    heapq.heappush(heap, (now, to[e]))
        if far[end] == math.inf:
            break
        potential = [int(p + min(f, far[end])) for p, f in zip(potential, far, strict=True)]
        while _blocking_flow(arcs, to, room, cost, potential, start, end):
            pass
    routed, e = [], routes
    for own in members:
        routed.append([room[e + 2 * k + 1] for k in range(len(own))])
        e += 2 * len(own)
    return routed


def _blocking_flow(arcs: list[list[int]], to: list[int], room: list[int], cost: list[int], potential: list[int], start: int, end: int) -> bool:
    """Send flow along arcs of no reduced cost, by the number of arcs from the start, until none of those paths has room; whether there was one."""
    level = {start: 0}
    layer = [start]
    while layer and end not in level:
        after = []
        for u in layer:
            for e in arcs[u]:
                v = to[e]
                if room[e] and v not in level and cost[e] + potential[u] == potential[v]:
                    level[v] = level[u] + 1
                    after.append(v)
        layer = after
    if end not in level:
        return False
    next_arc = dict.fromkeys(level, 0)
    path: list[int] = []
    u = start
    while True:
        if u == end:
            sent = min(room[e] for e in path)
            for e in path:
                room[e] -= sent
                room[e ^ 1] += sent
            # back to before the first arc that is full
            full = next(i for i, e in enumerate(path) if not room[e])
            u = to[path[full] ^ 1]
            del path[full:]
            continue
        own = arcs[u]
        while next_arc[u] < len(own):
            e = own[next_arc[u]]
            if room[e] and level.get(to[e], -1) == level[u] + 1 and cost[e] + potential[u] == potential[to[e]]:
                break
            next_arc[u] += 1
        if next_arc[u] < len(own):
            path.append(own[next_arc[u]])
            u = to[path[-1]]
        elif path:
            e = path.pop()
            u = to[e ^ 1]
            next_arc[u] += 1
        else:
            return True


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 20240501,
    id_col: str = "doc_id",
    most_patterns: int = 100_000,
) -> DataFrame:
    """Per row of docs: its id, ``sources``, ``size``, ``copies`` and ``taken`` = copies * size; plus the inputs of its first source.

    sources: an array of the names of the sources that hold the row, null names
    allowed; a null or empty array is the source null. size: its words; null is
    0. ``source_size`` and ``target`` are those of the row's first source (a row
    of several sources counts for the size of each). No row is taken more than
    ``repeats`` times. The order within a pattern is that of a hash of seed and
    id, then id: reruns agree, and equal rows are interchangeable. Rows without
    words are taken as often as their neighbours in that order, at no words. An
    empty table gives an empty result. Other columns are not returned. More than
    ``most_patterns`` sets of sources are an error: the flow between them is
    solved on the driver, in about a minute for the 100,000 of the default.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        names = F.coalesce(sources, F.array(F.lit(None).cast("string")))
        names = F.array_sort(F.array_distinct(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string")))))
        rows = docs.select(F.col(id_col).alias("id"), names.alias("pattern"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
        rows = scratch.save(rows.withColumn("order", F.xxhash64(F.lit(seed), F.col("id"))), "sizes", keep=True)
        # a power of two of parts, so that a part has some ten thousand rows however many there are
        bits = (max(LEAST_PARTS, rows.count() // PART_ROWS) - 1).bit_length()
        rows = rows.withColumn("part", F.shiftrightunsigned("order", 64 - bits).cast("int"))
        # one row per pattern and part of the order
        held = scratch.save(rows.groupBy("pattern", "part").agg(F.sum("size").alias("words")), "held")
        by_pattern = held.groupBy("pattern").agg(F.sum("words").alias("words"))
        if by_pattern.limit(most_patterns + 1).count() > most_patterns:
            raise ValueError(f"more than {most_patterns} membership patterns")
        patterns = sorted(((tuple(r["pattern"]), r["words"]) for r in by_pattern.collect()), key=lambda x: [(s is None, s or "") for s in x[0]])
        sizes: dict[str | None, int] = {}
        for own, words in patterns:
            for s in own:
                sizes[s] = sizes.get(s, 0) + words
        total = sum(words for _, words in patterns)
        target = source_targets(sizes, weights, share * total / max(1, sum(sizes.values())), repeats)
        index = {s: i for i, s in enumerate(target)}
        routed = min_cost_flow([w for _, w in patterns], [[index[s] for s in own] for own, _ in patterns], [round(target[s]) for s in index], repeats)
        ask = [(list(own), sizes[own[0]], float(target[own[0]]), *divmod(sum(flow), max(1, words))) for (own, words), flow in zip(patterns, routed, strict=True)]
        schema = "pattern array<string>, source_size long, target double, copies long, rest long"
        asked = F.broadcast(spark.createDataFrame(ask, T._parse_datatype_string(schema)))
        same = F.col("rows.pattern") == F.col("asked.pattern")
        # the part of the order in which the words asked for run out
        before = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = held.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
        starts = scratch.save(starts.alias("rows").join(asked.alias("asked"), same).select("rows.pattern", "part", "words", "start", "rest", "copies", "source_size", "target"), "starts", keep=True)
    # patterns * parts rows are bounded, but may be many: Spark broadcasts them only below its threshold
    joined = rows.join(starts, ["pattern", "part"])
    ends = F.col("start") + F.col("words")
    whole = joined.where((ends <= F.col("rest")) | (F.col("start") >= F.col("rest"))).withColumn("more", (ends <= F.col("rest")).cast("long"))
    edge = joined.where((ends > F.col("rest")) & (F.col("start") < F.col("rest")))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("upto", upto).withColumn("more", (F.col("start") + F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("upto")
    copies = F.least(F.col("copies") + F.col("more"), F.lit(repeats))
    out = whole.unionByName(edge).withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), F.col("pattern").alias("sources"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``mix`` for a table with one source per row and sizes in words."""
    return mix(docs, F.array(F.col(source_col).cast("string")), word_count(F.col(text_col)), id_col=id_col, **how)


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs as often as ``mixed`` takes them, columns as they are. Ids are unique in both."""
    own, times, copy = (spare_name(docs, c) for c in ("_mixed", "_copies", "_copy"))
    copies = mixed.where("copies > 0").select(F.col(id_col).alias(own), F.col("copies").alias(times))
    out = docs.join(copies, docs[id_col].eqNullSafe(F.col(own)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
