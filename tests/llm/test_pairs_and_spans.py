"""Joins and span finders against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphmill.llm import line_dedup, ngram_join, substring_dedup
from morphmill.llm._shared import join_groups
from morphmill.llm._text import line_hashes, word_hashes

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    words = GAP.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                i, j = find(sets[a][0]), find(sets[b][0])
                root[max(i, j)] = min(i, j)
    return {i: (len(s), find(i)) for i, s in sets}


def varied(n, seed):
    """Texts at all distances around the threshold, in chains."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.75:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, max(2, len(words) // 12))):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [f"w{rng.randrange(40)}"] * rng.randrange(2)
        else:
            words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 80, 200]))]
        rows.append((i, " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return rows


def joined(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, k, percent).collect()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_join_of_varied_texts(spark, k, percent):
    rows = varied(350, k)
    assert joined(spark, rows, k, percent) == components(rows, k, percent)


def test_join_with_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 16)
    rows = varied(250, 9)
    assert joined(spark, rows, 2, 70) == components(rows, 2, 70)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_of_documents(spark, small, k, percent):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert joined(spark, rows, k, percent) == components(rows, k, percent)


def test_linked_sets_share_a_routing_key():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for n in [1, 2, 3, 5, 9, 10, 11, 19, 20, 21, 40, 100, 300]:
            for _ in range(20):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                y = np.unique(np.concatenate([np.delete(x, rng.choice(len(x), rng.integers(0, n // 8 + 1), replace=False)), rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 2), dtype=np.uint64)]))
                if len(y) and len(x) and not np.array_equal(x, y) and ngram_join.linked(x, y, percent):
                    assert np.intersect1d(ngram_join.routing_keys(x, percent), ngram_join.routing_keys(y, percent)).size


def test_no_set_needs_the_key_for_all():
    """With hashes as tokens each set has more full parts than differences, so that no group is as large as the corpus."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        shared = {int(np.uint64(x).astype(np.int64)) for c in range(60) for x in ngram_join.mix(np.array([(c + 1 << 40) - 1], np.uint64))}
        for n in (12, 20, 39, 87, 130, 364, 545, 818, 1228, 5000):
            for _ in range(20):
                keys = ngram_join.routing_keys(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)), percent)
                assert not shared & set(keys.view(np.int64).tolist())


def test_join_with_a_key_of_very_many_sets(spark):
    """A third of all rows are near copies of one text, each different; they share keys, which are dealt by row."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(9000):
        if i % 3 == 0:
            words = list(base)
            words[-1] = f"x{i}"
        else:
            words = [f"w{rng.randrange(10**6)}" for _ in range(12)]
        rows.append((i, " ".join(words)))
    want = {i: (len(shingles(t, 3)), 0 if i % 3 == 0 else i) for i, t in rows}
    assert joined(spark, rows, 3, 90) == want


def units_of(text):
    out = []
    words = list(GAP.finditer(text or ""))
    first = 0
    for i, m in enumerate(words):
        if i + 1 == len(words) or m[0][-1] in ".!?" or "\n" in text[m.end() : words[i + 1].start()]:
            own = words[first : i + 1]
            out.append((tuple(lower(w[0]) for w in own), own[0].start(), own[-1].end()))
            first = i + 1
    return out


def test_repeated_spans_as_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    first = {}
    for i, text in sorted(rows):
        for n, (words, _, _) in enumerate(units_of(text)):
            first.setdefault(words, (i, n))
    want = {}
    for i, text in rows:
        runs, before = [], None
        for n, (words, a, b) in enumerate(units_of(text)):
            if first[words] != (i, n):
                if before == n - 1 and runs:
                    runs[-1] = (runs[-1][0], b, runs[-1][2] + len(words))
                else:
                    runs.append((a, b, len(words)))
                before = n
        want[i] = [(a, b) for a, b, n in runs if n >= 20]
    found = substring_dedup.repeated_spans(docs)
    assert {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found.collect()} == want
    assert any(want.values())
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_spans(docs, found).collect()}
    for i, text in rows:
        for a, b in reversed(want[i]):
            text = text[:a] + text[b:]
        assert left[i] == text


def test_passages_inside_long_lines_are_found(spark):
    """Planted passages of 50 words, and of one word over and over, in the middle of lines without sentence ends."""
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    passages = [words(50) for _ in range(100)] + [["again"] * 60]
    rows, inside = [], {}
    for i in range(202):
        before, passage = " ".join(words(rng.randrange(20, 90))), " ".join(passages[i % 101])
        rows.append((i, f"{before} {passage} {' '.join(words(rng.randrange(20, 90)))}"))
        inside[i] = (len(before) + 1, len(before) + 1 + len(passage))
    rows.append((202, " ".join(words(500))))
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cut_long=True).collect()}
    assert all(not got[i]["spans"] for i in [*range(100), 202])
    for i in range(101, 202):
        assert got[i]["removed_words"] >= 20
        assert all(inside[i][0] <= s["start"] and s["end"] <= inside[i][1] for s in got[i]["spans"])


def chunks_of(text):
    """(start, end in characters, number of lines) of the chunks of a text, its boundaries from one text at a time."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, doc = line_dedup.line_bounds(data, np.array([0, len(data)]))
    last = line_dedup.chunk_bounds(line_hashes(data, starts, ends), doc)
    first = [0, *(last[:-1] + 1).tolist()]
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b]]), b - a + 1) for a, b in zip(first, last.tolist(), strict=True)]


def test_repeated_chunks_as_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    first, own = {}, defaultdict(list)
    for i in sorted(rows):
        for a, b, n in chunks_of(rows[i]):
            if n > 1:
                own[i].append((a, b, n))
                first.setdefault(rows[i][a:b], (i, a))
    want = {i: ([(a, b) for a, b, _ in own[i] if first[t[a:b]] != (i, a)], len(t.split("\n")), len(own[i])) for i, t in rows.items()}
    got = {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], r["n_lines"], r["n_chunks"]) for r in line_dedup.repeated_chunks(docs).collect()}
    assert got == want and any(x[0] for x in want.values())


def test_chunks_after_an_inserted_line_stay():
    rng = random.Random(3)
    lines = [f"line {rng.random()}" for _ in range(200)]
    texts = ["\n".join(lines), "\n".join([*lines[:50], "new", *lines[50:]])]
    one, two = ({t[a:b] for a, b, _ in chunks_of(t)} for t in texts)
    assert len(one - two) <= 3


def test_short_passages_between_different_lines_are_removed(spark):
    """Planted passages of two to five lines, and single lines, which stay; all against brute force."""
    rng = random.Random(5)

    def line():
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))

    passages = [[line() for _ in range(2 + k % 4)] for k in range(40)]
    rows, planted = [], {}
    for i in range(120):
        text = [line() for _ in range(rng.randrange(1, 6))]
        passage = passages[i % 40]
        at = len(text)
        text += passage + [line() for _ in range(rng.randrange(1, 6))] + [passages[(i + 1) % 40][0]] + [line()]
        planted[i] = "\n".join(passage)
        rows.append((i, "\n".join(text)))
        if i >= 40:
            start = len("\n".join(text[:at])) + 1
            planted[i] = [(start, start + len(planted[i]), len(passage))]
        else:
            planted[i] = []
    got = {r["doc_id"]: r for r in line_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: [(s["start"], s["end"]) for s in r["spans"]] for i, r in got.items()} == {i: [(a, b) for a, b, _ in x] for i, x in planted.items()}
    assert {i: r["removed_lines"] for i, r in got.items()} == {i: sum(n for _, _, n in x) for i, x in planted.items()}


def test_repeated_passages_as_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = {r["doc_id"]: r["text"].split("\n") for r in docs.select("doc_id", "text").collect()}
    first, want = {}, {}
    for i in sorted(rows):
        lines, gone = rows[i], set()
        for n in range(len(lines) - 1):
            a, at = first.setdefault((lines[n], lines[n + 1]), (i, n))
            if a != i or n > at + 1:
                gone |= {n, n + 1}
        want[i] = len(gone)
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.repeated_passages(docs).collect()}
    assert got == want


def test_overlapping_and_empty_lines(spark):
    docs = spark.createDataFrame([(1, "a\na\na\na\na"), (2, "x\n\n\ny"), (3, "z\n\n\n\ny\n\n"), (4, "q\nx\n\n\ny\nr"), (5, "only"), (6, "only"), (None, "a\na"), (7, None)], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["removed_lines"]) for r in line_dedup.repeated_passages(docs).collect()}
    none = ([], 0)
    assert got == {1: ([(4, 9)], 3), 2: none, 3: none, 4: ([(2, 7)], 4), 5: none, 6: none, None: none, 7: none}


def test_no_chunk_of_one_line():
    rng = np.random.default_rng(2)
    for _ in range(50):
        doc = np.sort(rng.integers(0, 12, 60))
        last = line_dedup.chunk_bounds(rng.integers(0, 1 << 63, 60, dtype=np.uint64), doc)
        first = np.concatenate(([0], last[:-1] + 1))
        assert (doc[first] == doc[last]).all()
        assert all(b > a or (doc == doc[a]).sum() == 1 for a, b in zip(first, last, strict=True))


def test_colliding_chunks_are_told_apart(spark, medium):
    """With hashes of two bits the byte comparison alone tells chunks apart, to the same spans."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("doc_id < 300")
    for find in (line_dedup.repeated_chunks, line_dedup.repeated_passages):
        got, want = ({r["doc_id"]: r["spans"] for r in find(docs, hash_bits=bits).collect()} for bits in (2, 64))
        assert got == want and any(want.values())


def hot_rows(n):
    """A line pair, a sentence run and a whole text that every third row holds, among others."""
    common = "the same first line of very many texts here\nand its second line with some more words in it"
    rng = random.Random(n)
    rows = []
    for i in range(n):
        own = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(3))
        rows.append((i, common if i % 3 == 0 else f"{own}\n{common}\n{own[::-1]}"))
    return rows, common


@pytest.mark.parametrize("bits", [64, 1])
def test_one_passage_in_every_row(spark, bits):
    rows, common = hot_rows(3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in line_dedup.repeated_passages(docs, hash_bits=bits).collect()}
    want = {i: [] if i == 0 else [(t.index(common), t.index(common) + len(common))] for i, t in rows}
    assert got == want
    if bits == 64:
        units = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring_dedup.repeated_spans(docs, least_words=5).collect()}
        assert units == want


def test_joins_of_hot_groups_stay_in_place(spark, tmp_path):
    """A key of a third of all rows is broadcast, so that its rows are in no exchange; the join's rows are those of a plain one."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    rows.write.parquet(f"file://{tmp_path}/rows")
    rows = spark.read.parquet(f"file://{tmp_path}/rows")
    rows.groupBy("k").agg(F.count("*").alias("n")).write.parquet(f"file://{tmp_path}/groups")
    groups = spark.read.parquet(f"file://{tmp_path}/groups")
    joined = join_groups(rows, groups, ["k"], "n")
    assert sorted(joined.collect()) == sorted(rows.join(groups, "k").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_groups(rows, groups, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [k" in plan and "LeftAnti" in plan and "SortMergeJoin" in plan


def test_word_hashes_tell_words_apart():
    words = [f"{a}{b}" for a in "abcdé" for b in range(2000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = __import__("morphmill.llm._text", fromlist=["word_bounds"]).word_bounds(data, np.array([0, len(data)]))
    assert len(set(word_hashes(data, starts, ends).tolist())) == len(words)
