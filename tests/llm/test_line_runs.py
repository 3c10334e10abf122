"""Overlapping content-defined chunks: what they find, that nothing is found without them, and by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from morphmill.llm import line_dedup
from morphmill.llm._text import line_bounds, line_hashes

from .test_pairs_and_spans import hot_rows


def chunks_of(text):
    """(first, last, before, after) lines of a text's overlapping chunks."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, doc = line_bounds(data, np.array([0, len(data)]))
    found = line_dedup.overlapping_chunks(line_hashes(data, starts, ends), doc, ends > starts)
    return list(zip(*(x.tolist() for x in found[:4]), strict=True))


def by_brute_force(rows):
    """removed_lines of each id: chunks by their lines, extended by one equal line to either side."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a, b, left, right in chunks_of(text):
            j, c, d, low, high, theirs = seen.setdefault(tuple(lines[a : b + 1]), (i, a, b, left, right, lines))
            if j != i or a > d:
                gone |= set(range(a, b + 1))
                if left >= 0 and low >= 0 and lines[left:a] == theirs[low:c]:
                    gone |= set(range(left, a))
                if right >= 0 and high >= 0 and lines[b + 1 : right + 1] == theirs[d + 1 : high + 1]:
                    gone |= set(range(b + 1, right + 1))
        out[i] = len(gone)
    return out


def pairs_only(rows):
    """removed_lines by all pairs of neighbouring lines that are not empty."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        full = [k for k, x in enumerate(lines) if x]
        for a, b in zip(full, full[1:], strict=False):
            key = tuple(lines[a : b + 1])
            gone |= set(range(a, b + 1)) if key in seen else set()
            seen.add(key)
        out[i] = len(gone)
    return out


def runs(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in line_dedup.repeated_runs(docs, **how).collect()}


def test_runs_as_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in line_dedup.repeated_runs(docs).collect()}
    assert {i: r["removed_lines"] for i, r in got.items()} == by_brute_force(rows)
    assert all(r["n_chunks"] == len(chunks_of(dict(rows)[i])) for i, r in got.items())
    assert sum(r["removed_lines"] for r in got.values()) >= 0.9 * sum(pairs_only(rows).values())


@pytest.fixture(scope="module")
def planted():
    """Runs of 2, 3, 5 and 8 lines, each in two texts of else different lines."""
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))
    rows, of = [], {}
    for n in (2, 3, 5, 8):
        for _ in range(150):
            run = [line() for _ in range(n)]
            for _ in range(2):
                of[len(rows)] = n
                rows.append((len(rows), "\n".join([line() for _ in range(rng.randrange(1, 5))] + run + [line() for _ in range(rng.randrange(1, 5))])))
    return rows, of


def test_recall_of_planted_runs(spark, planted):
    rows, of = planted
    got = runs(spark, rows)
    for n in (2, 3, 5, 8):
        lines = [got[i]["removed_lines"] for i in of if of[i] == n]
        assert max(lines) == n and sum(lines) >= 0.9 * n * len(lines) / 2
    assert sum(bool(r["removed_lines"]) for r in got.values()) <= len(rows) / 2


def test_nothing_is_found_without_chunks(planted, monkeypatch):
    """Chunks are the only way in: where every place refuses one, no line has a chunk."""
    rows, _ = planted
    assert any(chunks_of(t) for _, t in rows)
    monkeypatch.setattr(line_dedup, "REFUSE", 1)
    assert not any(chunks_of(t) for _, t in rows)


def test_chunks_end_by_their_content():
    """A chunk's lines are the same whatever lies around them, and some have over two."""
    rng = random.Random(2)
    line = lambda: f"l{rng.randrange(10**9)}"
    inner = [line() for _ in range(400)]
    texts = ["\n".join([line() for _ in range(k)] + inner + [line() for _ in range(3)]) for k in (1, 2, 7)]
    found = [{tuple(t.split("\n")[a : b + 1]) for a, b, *_ in chunks_of(t)} for t in texts]
    own = set(inner)
    inside = [{c for c in f if set(c) <= own} for f in found]
    assert inside[0] == inside[1] == inside[2] and len(inside[0]) > 350
    assert {len(c) for c in inside[0]} >= {2, 3}


def test_odd_lines(spark):
    rows = [(1, "a\na\na\na\na"), (2, "x\n\n\ny"), (3, "z\n\n\n\ny\n\n"), (4, "q\nx\n\n\ny\nr"), (5, "only"), (6, "only"), (7, "\n\n"), (8, "")]
    got = runs(spark, [*rows, (None, "a\na"), (9, None), (None, None)])
    want = by_brute_force(rows)
    assert {i: r["removed_lines"] for i, r in got.items() if i and i < 9} == want
    assert got[None]["spans"] == [] and got[9]["n_lines"] == 1
    assert runs(spark, []) == {}


@pytest.mark.parametrize("bits", [64, 1])
def test_one_run_in_every_row(spark, bits):
    rows, common = hot_rows(3000)
    got = {i: [tuple(s) for s in r["spans"]] for i, r in runs(spark, rows, hash_bits=bits).items()}
    assert got == {i: [] if i == 0 else [(t.index(common), t.index(common) + len(common))] for i, t in rows}


def test_colliding_chunks(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("doc_id < 300")
    got, want = ({r["doc_id"]: r["removed_lines"] for r in line_dedup.repeated_runs(docs, hash_bits=bits).collect()} for bits in (3, 64))
    assert sum(want.values()) and sum(abs(got[i] - want[i]) for i in want) <= 0.1 * sum(want.values())
