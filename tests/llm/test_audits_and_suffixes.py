"""Filter audit, suffix deduplication and source divergence against brute force, over odd rows and in their rarer ways."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from morphmill.llm import queries, source_divergence, suffix_dedup
from morphmill.llm.filter_audit import filter_audit
from morphmill.llm.source_divergence import SourceTrie
from morphmill.llm.suffix_dedup import BlindTrie, repeated_strings, suffix_order

from .test_documents import EXTRA, ROWS, SCHEMA

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, *EXTRA) for r in ROWS], SCHEMA).repartition(3)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (4, 1, 1), (None, 1, 1), (2, None, None), (2, 1, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_suffix_dedup", "op13_source_divergence"])
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    got = queries.queries()[name](spark, small)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(found.fetchall())


# --- filters


def audited(rows, judged):
    """RESULT by walking every order over every document."""
    docs = []
    for i, text, _, part in rows:
        text, words = text or "", WORDS.findall(text or "")
        first = min((j for j, t, *_ in rows if (t or "") == text and j is not None), default=None)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first is not None and i > first,
        }
        own = [x for x in judged if x[0] == i and i is not None]
        docs.append((part or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, removed_by = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                every = [d for d in docs if d[0] == part and f in d[1]]
                removed_by[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(every) - len(gone), sum(d[1] == {f} for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark, odd):
    got = filter_audit(odd, labels(spark)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(found) == len(got) == 600 * len({r[3] or "" for r in ROWS})
    assert found == audited(ROWS, [tuple(r) for r in labels(spark).collect()])


def test_audit_of_many_failures(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["low", "Up", "100%", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([1, 150, 250, 400]))) for _ in range(40)]
    rows = [(i, rng.choice(pool), "en", rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(i, " ".join(f"word{k}" for k in range(300 + i)), "en", "a") for i in range(200, 210)]
    judged = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 210, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = filter_audit(docs, spark.createDataFrame(judged, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == audited(rows, judged)


def test_audit_of_nothing(spark, odd):
    assert filter_audit(odd.where("false"), labels(spark)).collect() == []
    assert all(r["good_lost"] == 0 for r in filter_audit(odd, labels(spark).where("false")).collect())


# --- suffixes


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((len(d), [tuple(x) for x in edges.reshape(-1, 2).tolist()], hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def repeats(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(repeated_strings(docs, kept=True, **how).collect())
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    return [(r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in got]


def passages(seed):
    """Texts that share passages around the length of a repeat, also overlapping, at ends, and periodic ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "x", "", "\x00"]) + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))
    plain = lambda n: " ".join(word() for _ in range(n))
    shared = [plain(n) for n in (12, 15, 18, 20, 22, 25, 40, 90)] + ["ab" * 80, "a" * 130, "abc " * 50]
    texts = [None, "", "short", plain(60)]
    for _ in range(70):
        t = "".join(rng.choice([plain(rng.randrange(0, 20)), rng.choice(shared), rng.choice(shared)[rng.randrange(9) :]]) for _ in range(rng.randrange(1, 6)))
        texts += [t] * rng.choice([1, 1, 1, 2, 3])
    texts += [t[:-1] + "!" for t in texts[-5:]]
    return texts


@pytest.mark.parametrize("length,most", [(80, 20_000), (100, 20_000), (90, 2)])
def test_repeats_as_brute_force(spark, length, most):
    texts = passages(length)
    assert repeats(spark, texts, length=length, most=most) == without_repeats(texts, length)


def test_long_texts_repeat(spark):
    rng = random.Random(8)
    long = "".join(chr(rng.randrange(97, 123)) for _ in range(2_600_000))
    passage = long[1_048_576 - 150 : 1_048_576 + 150]
    texts = [long, "x" + passage + "y", "own text " + "".join(rng.choice("abcdefgh") for _ in range(500))]
    got = repeats(spark, texts)
    assert [x[1] for x in got] == [[(1_048_576 - 150, 1_048_576 + 150)], [(1, 301)], []]


def test_repeats_of_odd_rows(spark, odd):
    got = repeated_strings(odd).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(r[0] or -1 for r in ROWS)
    want = without_repeats([r[1] for r in ROWS if len(r[1] or "") < 10_000], 200)
    assert Counter((r["n_bytes"], r["kept_sha256"]) for r in got if r["n_bytes"] < 10_000) == Counter((n, s) for n, _, s in want)
    long = next(r for r in got if r["n_bytes"] > 10_000)
    assert [tuple(s) for s in long["spans"]] == [(0, long["n_bytes"])]
    assert repeated_strings(odd.where("false")).collect() == []


def test_order_of_suffixes():
    rng = random.Random(3)
    for _ in range(200):
        strings, groups = [], []
        for g in range(rng.randrange(1, 4)):
            base = bytes(rng.choice(b"ab\x00") for _ in range(200))
            for _ in range(rng.randrange(1, 12)):
                own = bytearray(base[: rng.choice([0, 1, 2, 5, 63, 64, 65, 100, 200])])
                if own and rng.random() < 0.5:
                    own[rng.randrange(len(own))] = rng.choice(b"ab\x00\xff")
                strings.append(bytes(own))
                groups.append(g)
        sizes = np.array([len(s) for s in strings])
        order, lcp = suffix_order(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array(groups))
        assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings, strict=True))
        for k, i in enumerate(order):
            if k == 0 or groups[order[k - 1]] != groups[i]:
                assert lcp[k] == -1
            else:
                before = strings[order[k - 1]]
                assert lcp[k] == next((j for j, (a, b) in enumerate(zip(before, strings[i], strict=False)) if a != b), min(len(before), len(strings[i])))


def test_blind_trie_keeps_equal_strings():
    trie = BlindTrie()
    for n, s in enumerate([b"abc", b"ab", b"abc", b"b", b"", b"ab\x00"]):
        trie.add(s, n)
    assert list(trie.in_order()) == [([4], -1), ([1], 0), ([5], 2), ([0, 2], 2), ([3], 0)]


# --- sources


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def diverged(rows, least, ranks=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        groups.add((lang, source))
        terms = TERMS.findall(lowered(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t in docs[lang] if docs[lang][t] >= least)
        every = Counter()
        for k in groups:
            every.update(counts[k] if k[0] == lang else {})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        own, all_ = share(counts[lang, source]), share(every)
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = share(counts[lang, other])
            pairs.append((-sum(abs(own[t] - theirs[t]) for t in kept), other.encode(), other))
        best = [(-(own[t] - all_[t]), t.encode(), t) for t in kept if counts[lang, source][t] and own[t] > all_[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:ranks])):
            out |= {(lang, source, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


def said(seed, n=150, sources=7):
    rng = random.Random(seed)
    pool = ["Äpfel", "apple", "APPLE", "it's", "naïve", "日本語", "zebra", "a", "x1y2", "\x00nul", "ſ", "É"] + [f"w{chr(97 + i)}{chr(97 + k)}" for i in range(9) for k in range(9)]
    rows = [(" ".join(rng.choices(pool, k=rng.randrange(40))), rng.choice(["en", "en", "de", None]), rng.choice([*(f"s{i}" for i in range(sources)), "", None])) for _ in range(n)]
    return [*rows, (None, "en", "mute"), ("1 2 3", "xx", "mute"), ("", "xx", "other")]


def divergence(spark, rows, **how):
    got = source_divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4), **how).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


@pytest.mark.parametrize("least,tile", [(1, 256), (12, 256), (5, 2)])
def test_divergence_as_brute_force(spark, monkeypatch, least, tile):
    monkeypatch.setattr(source_divergence, "TILE", tile)
    rows = said(least)
    assert divergence(spark, rows, least_docs=least, ranks=9) == diverged(rows, least, 9)


def test_divergence_of_odd_rows(spark, odd):
    rows = [(r[1], r[2], r[3]) for r in ROWS]
    assert {tuple(r) for r in source_divergence.source_divergence(odd, least_docs=1).collect()} == diverged(rows, 1)
    assert source_divergence.source_divergence(odd.where("false")).collect() == []


def leaves(batches):
    return {(r["lang"], r["term"]): (r["docs"], dict(zip(r["keys"], r["counts"], strict=True))) for b in batches for r in b.to_pylist()}


def texts_of(rows):
    own = [(g or "", len(s or "") * 7 + ord((s or "0")[-1]) % 5, t or "") for t, g, s in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], ["lang", "key", "text"])


def merged(parts, least=1, rows=5):
    """Sub-tries through the order and the batches that a range gets."""
    table = pa.Table.from_batches(parts)
    order = sorted(range(len(table)), key=lambda k: (table["lang"][k].as_py(), table["prefix"][k].as_py()))
    return leaves(source_divergence.merge_batches(iter(table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=rows)), least))


def test_tries_in_small_parts(monkeypatch):
    """Full tries and sub-tries that go on in the next batch change no count."""
    batch = texts_of(said(4))
    counts, docs = defaultdict(Counter), Counter()
    for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        terms = TERMS.findall(lowered(text))
        docs.update((lang, t) for t in set(terms))
        for t in terms:
            counts[lang, t][key] += 1
    want = {k: (docs[k], dict(counts[k])) for k in counts}
    assert merged(list(source_divergence.count_batches(iter([batch])))) == want
    for name, value in (("TEXT_AT_ONCE", 300), ("MOST_LEAVES", 40), ("MOST_COUNTERS", 60), ("ROWS", 3)):
        monkeypatch.setattr(source_divergence, name, value)
    parts = list(source_divergence.count_batches(iter([batch.slice(0, 60), batch.slice(60)])))
    assert sum(len(b) for b in parts) > len(want) / 2
    assert merged(parts) == want
    assert merged(parts, 9) == {k: v for k, v in want.items() if v[0] >= 9}


def test_labels_of_a_trie():
    """A leaf has what it doesn't share with the one before; leaves are in the order of their bytes, sub-tries share three."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("aäbé日") for _ in range(rng.choice([1, 2, 3, 9, 30]))).encode() for _ in range(500)})
    shared = source_divergence.shared_prefixes(pa.array(words, pa.binary())).tolist()
    assert shared == [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:], strict=False)]
    trie = SourceTrie()
    mixed = rng.sample(words, len(words))
    trie.add(pa.array(mixed, pa.binary()), np.arange(len(mixed)), trie.group_of(pa.array(["en"] * len(mixed)), pa.array([1] * len(mixed), pa.int64())), np.full(len(mixed), 2), np.ones(len(mixed), np.int64))
    found = []
    for row in (r for b in trie.tries() for r in b.to_pylist()):
        before, at = b"", 0
        for k, n in zip(row["shared"], row["sizes"], strict=True):
            before = before[:k] + row["labels"][at : at + n]
            at += n
            found.append(before)
            assert before[:3] == row["prefix"]
    assert found == words


def test_shares_of_large_counts():
    count, total = np.array([0, 7, 10**12, 9 * 10**17]), np.array([10**6, 12, 3 * 10**15, 10**18])
    assert [int(x) for x in source_divergence.shares(count, total)] == [1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(count, total, strict=True)]
