"""Mixing, rules, personal data, classifier, BPE, WARC, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from morphmill.llm import bpe, mixing, pii, quality_classifier, quality_rules, queries, warc
from tests.llm.test_pairs_and_spans import components, lower

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, small, name):
    got = queries.queries()[name](spark, small)
    columns = sorted(got.columns)
    found = duck.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert Counter(map(repr, map(tuple, got.select(*columns).collect()))) == Counter(repr(tuple(r[i] for i in at)) for r in found.fetchall())


# ---- rules


def test_bad_hosts(spark):
    """Planted hosts: bad ones lose their clean documents too; sparse ones and the null host are shrunk to the corpus."""
    clean = " ".join(f"word{i} and" for i in range(40))
    junk = "# * | " * 60
    rng = random.Random(6)
    shares = {"good": (300, 0.02), "fair": (300, 0.12), "bad": (200, 0.6), "worse": (90, 0.95), "sparse": (2, 1.0), "one": (1, 0.0), None: (40, 0.05)}
    shares |= {f"plain{i}": (60, 0.05) for i in range(12)}
    rows = []
    for host, (n, share) in shares.items():
        failing = {*range(round(n * share))}
        rows += [(host, junk if k in failing else clean + f" {host} {k}") for k in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    judged = quality_rules.quality_rules(docs).collect()
    assert {r["host"] for r in judged if r["host_bad"]} == {"bad", "worse"}
    lost = [r for r in judged if not r["kept"] and rows[r["doc_id"]][1] != junk]
    assert len(lost) == 80 + round(90 * 0.05) and {r["host"] for r in lost} == {"bad", "worse"}
    con = duckdb.connect()
    planted = docs.toPandas()  # noqa: F841
    con.execute("create table documents as select * from planted")
    want = dict(con.execute(f"select doc_id, kept from ({queries.OP2_SQL})").fetchall())
    assert {r["doc_id"]: r["kept"] for r in judged} == want


# ---- mixing


def test_targets():
    assert mixing.source_targets({"a": 100, "b": 100, None: 100}) == {"a": 200, "b": 250 / 3, None: 500 / 3}
    assert mixing.source_targets({}) == {}
    assert mixing.source_targets({"a": 0, "b": 10}) == {"a": 0, "b": 15}


def test_mix_comes_near_its_targets(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.mix_documents(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    # 20 sources in the order of their names weigh 3, 1, 2, ..., and share one and a half of all words, none more than twice its own
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(sorted(sizes))}
    low, high = 0.0, 10.0 * sum(sizes.values())
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(unit * weight[s], 2 * sizes[s]) for s in sizes) < 1.5 * sum(sizes.values()) else (low, unit)
    assert target == pytest.approx({s: min(low * weight[s], 2 * sizes[s]) for s in sizes})
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(rows) == sorted(mixing.mix_documents(docs.repartition(5)).collect())


def cheapest(capacity, members, quotas, repeats):
    """(words routed, cost) by trying every routing; for tiny networks."""
    edges = [(p, s) for p, own in enumerate(members) for s in own]

    def cost(p, n):
        return sum(r * max(0, min(n - r * capacity[p], capacity[p])) for r in range(repeats))

    best = (0, 0)

    def go(k, used, given, total):
        nonlocal best
        if k == len(edges):
            best = max(best, (total, -sum(cost(p, n) for p, n in enumerate(used))))
            return
        p, s = edges[k]
        for n in range(min(repeats * capacity[p] - used[p], quotas[s] - given[s]) + 1):
            go(k + 1, [u + n * (i == p) for i, u in enumerate(used)], [g + n * (i == s) for i, g in enumerate(given)], total + n)

    go(0, [0] * len(capacity), [0] * len(quotas), 0)
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        capacity, quotas = [rng.randrange(4) for _ in range(3)], [rng.randrange(5) for _ in range(2)]
        members = [rng.choice([[0], [1], [0, 1]]) for _ in capacity]
        routed = mixing.min_cost_flow(capacity, members, quotas, 2)
        used = [sum(r) for r in routed]
        total = sum(used)
        cost = sum(max(0, u - c) for u, c in zip(used, capacity, strict=True))
        assert all(u <= 2 * c for u, c in zip(used, capacity, strict=True))
        assert (total, -cost) == cheapest(capacity, members, quotas, 2)


def test_flow_of_many_overlapping_patterns():
    """Two thousand patterns over 20 sources, in seconds, and as cheap as a linear bound says: no quota is left that words could fill."""
    import time

    rng = random.Random(3)
    members = list({tuple(sorted(rng.sample(range(20), rng.randrange(2, 6)))) for _ in range(2600)})[:2000]
    capacity = [rng.randrange(1, 1000) for _ in members]
    quotas = [rng.randrange(20_000, 140_000) for _ in range(20)]
    began = time.perf_counter()
    routed = mixing.min_cost_flow(capacity, [list(x) for x in members], quotas, 2)
    assert time.perf_counter() - began < 20
    given = [0] * 20
    for own, words, c in zip(members, routed, capacity, strict=True):
        assert sum(words) <= 2 * c and min(words) >= 0
        for s, w in zip(own, words, strict=True):
            given[s] += w
    assert all(g <= q for g, q in zip(given, quotas, strict=True))
    # of an optimal routing no arc leads from words left over to a quota left open, nor from unused words to one that repeats others'
    reach = {s for s in range(20) if given[s] < quotas[s]}
    for source_words in ("free", "any"):
        own = set(reach)
        seen = True
        while seen:
            seen = False
            for ms, words, c in zip(members, routed, capacity, strict=True):
                if own & set(ms):
                    assert sum(words) >= (c if source_words == "free" else 2 * c) or not reach
                    more = {s for s, w in zip(ms, words, strict=True) if w} - own
                    own |= more
                    seen |= bool(more)


def test_overlapping_sources(spark):
    rows = [(i, ["a"] if i < 60 else ["a", "b"] if i < 80 else ["b"], 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>, n long")
    got = mixing.mix(docs, F.col("s"), F.col("n")).collect()
    taken = sum(r["taken"] for r in got)
    assert abs(taken - 1500) <= 20 and all(r["taken"] <= 20 for r in got)


# ---- personal data


def spans_by_regex(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    tests = [("email", email, lambda s: True), ("ip", ip, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", card, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", phone, lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, *m.span()) for k, p, ok in tests for m in p.finditer(text) if ok(m[0])]


def test_base_spans_as_by_regex(small, spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("a@.b-+_%1 2()3é\n") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice("0123456789. -+@a") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in texts:
        assert pii.base_spans(t) == spans_by_regex(t), t


def test_gradients():
    rng = np.random.default_rng(1)
    model = pii.Tagger(hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(1, 20, (7, 4)).astype(np.uint8), rng.integers(0, pii.TAGS, (7, 4))
    _, grad = model.loss(x, y)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        for k in rng.choice(flat.size, 3):
            before, step = flat[k], 1e-2
            flat[k] = before + step
            up = model.loss(x, y)[0]
            flat[k] = before - step
            down = model.loss(x, y)[0]
            flat[k] = before
            assert grad[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_tags_are_the_best_path(spark):
    """Runs of characters that may have a tag, decoded apart, against one path over all scores of the whole text."""
    rng = np.random.default_rng(3)
    for seed in range(6):
        model = pii.Tagger(hidden=4, seed=seed)
        model.p["move"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
        model.p["bias"] = np.array([1.5, 0, 0, 0, 0], np.float32)
        texts = ["".join(rng.choice(list("ab1@. +é"), rng.integers(0, 700))) for _ in range(5)] + ["x", ""]
        for text, found in zip(texts, pii.tagged_spans(model, texts), strict=True):
            ids, emit = pii.symbols(text), np.zeros((len(text), pii.TAGS), np.float32)
            for s in pii.window_starts(len(text)):
                x = np.zeros((pii.WINDOW, 1), np.uint8)
                x[: len(ids[s : s + pii.WINDOW]), 0] = ids[s : s + pii.WINDOW]
                lo, hi = (0 if s == 0 else pii.OVERLAP // 2), min(pii.WINDOW, len(text) - s)
                emit[s + lo : s + hi] = model.emissions(x)[lo:hi, :, 0]
            want = np.zeros(len(text), int)
            if len(text):
                score, back = emit[0].astype(float), []
                for t in range(1, len(text)):
                    way = score[:, None] + model.p["move"]
                    back.append(way.argmax(axis=0))
                    score = way.max(axis=0) + emit[t]
                want[-1] = score.argmax()
                for t in range(len(text) - 1, 0, -1):
                    want[t - 1] = back[t - 1][want[t]]
            got = np.zeros(len(text), int)
            for tag, a, b, _ in found:
                got[a:b] = tag
            assert np.array_equal(got, want)


def joined_spans(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def planted_forms(texts, seed):
    """(text, kind, start, end): in every other text a form that no base rule knows, cards with a right check digit."""
    rng, out = np.random.default_rng(seed), []
    for i, text in enumerate(texts):
        gaps = [k for k, c in enumerate(text) if c == " "]
        if i % 2 or len(gaps) < 3:
            out.append((text, None, 0, 0))
            continue
        while True:
            kind, put = pii.generated(rng)
            if kind == "card":
                body = [k for k, c in enumerate(put) if c.isdigit()]
                put = next(p for d in "0123456789" if pii.luhn(re.sub("[^0-9]", "", p := put[: body[-1]] + d)))
            if not spans_by_regex(put):
                break
        at = gaps[int(rng.integers(len(gaps)))]
        out.append((f"{text[:at]} {put}{text[at:]}", kind, at + 1, at + 1 + len(put)))
    return out


def test_added_spans_of_planted_data(spark, medium):
    """The operator over whole texts: base spans as by regular expressions, precision and recall of what the model adds."""
    rows = planted_forms([r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()], 17)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string").repartition(8)
    right = wrong = planted = 0
    for r in pii.find_personal_data(docs).collect():
        text, kind, a, b = rows[r["doc_id"]]
        base = spans_by_regex(text)
        assert r["base_sha256"] == hashlib.sha256(joined_spans(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        every = [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in r["spans"].split(",") if s)]
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), s[1])) and set(base) <= set(every) and r["n_added"] == len(every) - len(base)
        added = set(every) - set(base)
        planted += kind is not None
        right += (kind, a, b) in added
        wrong += len(added - {(kind, a, b)})
    assert planted > 400 and right / planted > 0.85 and right / (right + wrong) > 0.95


def test_held_out_tags(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"]]
    pieces = [t[s : s + pii.WINDOW] for t in texts for s in range(0, min(len(t), 1200), pii.WINDOW)]
    model = pii.train(pieces[::2])
    x, y = pii.training_windows(pieces[1::2], seed=99)
    got = np.zeros(y.shape, int)
    for row, found in zip(got, pii.tagged_spans(model, ["".join(chr(c - 1) if c else " " for c in w) for w in x]), strict=True):
        for tag, a, b, _ in found:
            row[a:b] = tag
    marked = y > 0
    assert (got == y).mean() > 0.97 and ((got == y) & marked).sum() / marked.sum() > 0.75


def test_windows_do_not_change_results(spark, small):
    model = pii.Tagger()
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(30).collect()]
    for t, found in zip(texts, pii.tagged_spans(model, texts), strict=True):
        assert [f[:3] for f in pii.tagged_spans(model, [t])[0]] == [f[:3] for f in found]


def test_long_unbroken_texts_are_linear():
    """A text without white space, every fourth character tagged, within seconds."""
    import time

    text = "ab1@" * 250_000
    began = time.perf_counter()
    pii.added_spans(text, [(1, a, a + 1, 9.0) for a in range(0, len(text), 4)], pii.base_spans(text))
    assert time.perf_counter() - began < 30


# ---- classifier


def test_held_out_accuracy(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    seen, rest = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in quality_classifier.classify(docs, seen).collect() if r["doc_id"] in rest]
    right = np.mean([r["kept"] == bool(rest[r["doc_id"]]) for r in rows])
    base = max(np.mean(list(rest.values())), 1 - np.mean(list(rest.values())))
    assert right >= max(0.9, base)


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 0.9)] * 500 + [("big", "b", 0.2)] * 3 + [("small", "a", 0.1)] * 2 + [(None, None, 0.5)]
    paths, _ = quality_classifier.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    rate = {(r["host"], r["path"]): r["path_rate"] for r in paths.collect()}
    assert abs(rate["big", "a"] - 0.9) < 0.01 and rate["big", "b"] > 0.2 and rate["small", "a"] > 0.1 and len(rate) == 4


def test_posteriors_as_brute_force(spark):
    """Rates of hosts and paths, strengths by moments, from plain sums."""
    rng = random.Random(9)
    rows = []
    for h in [*range(12), None]:
        base = rng.random()
        for p in range(rng.randrange(1, 4)):
            own = min(1, max(0, base + rng.uniform(-0.2, 0.2)))
            rows += [(None if h is None else f"h{h}", f"p{p}", min(1.0, max(0.0, rng.gauss(own, 0.3)))) for _ in range(rng.choice([1, 2, 5, 40, 200]))]

    def strength(groups, mean):
        noise, n = mean * (1 - mean), sum(k for k, _ in groups)
        spread = (sum(s * s / k for k, s in groups) - n * mean * mean - (len(groups) - 1) * noise) / max(n - sum(k * k for k, _ in groups) / n, 1)
        return 1e4 if spread <= noise / 1e4 else max(noise / spread - 1, 1)

    by_path, by_host = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, p, x in rows:
        for group in (by_path[h, p], by_host[h]):
            group[0] += 1
            group[1] += x
    mean = sum(x for _, _, x in rows) / len(rows)
    of_host, of_path = strength(list(by_host.values()), mean), strength(list(by_path.values()), mean)
    host = {h: (s + of_host * mean) / (n + of_host) for h, (n, s) in by_host.items()}
    want = {(h, p): (host[h], (s + of_path * host[h]) / (n + of_path)) for (h, p), (n, s) in by_path.items()}
    paths, _ = quality_classifier.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in paths.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_words_are_evidence(spark):
    """Labels that only words tell apart, among texts of the same lengths and marks."""
    rng = random.Random(10)
    words = [[f"{c}{''.join(rng.choice('aeiourst') for _ in range(5))}" for _ in range(40)] for c in "gb"]
    rows = [(i, " ".join(rng.choice(words[i % 2] if rng.random() < 0.6 else words[1 - i % 2]) for _ in range(60)), "en", "web") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(600)], "doc_id long, quality int")
    got = [r["kept"] == (r["doc_id"] % 2 == 0) for r in quality_classifier.classify(docs, labels).collect() if r["doc_id"] >= 600]
    # against the rule that knows the two lists of words
    good = set(words[0])
    ideal = [(sum(w in good for w in text.split()) > 30) == (i % 2 == 0) for i, text, _, _ in rows if i >= 600]
    assert np.mean(got) > np.mean(ideal) - 0.06


# ---- BPE


def test_ids_and_texts_as_the_library(spark, small):
    rng = random.Random(4)
    docs = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += ["".join(rng.choice("abcABC eéÉßΣσς'ſK'sll12３٣ \n\t<|endoftext|>🙂汉字ﬁ́") for _ in range(rng.randrange(40))) for _ in range(1500)]
    docs += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|", "ΑΣ ΑΣΑ", "İstanbul", "don't we'll", "", " ", "x" * 5000, "\x00\x01", "é" * 300]
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    rows = spark.createDataFrame([*enumerate(docs), (len(docs), None)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in bpe.digests(rows, VOCABULARY).collect()}
    for i, text in [*enumerate(docs), (len(docs), "")]:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(text)
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest(), repr(text)


def test_decode_operator(spark):
    rows = spark.createDataFrame([(1, "Hello there"), (2, None), (3, "")], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(rows, VOCABULARY), VOCABULARY).collect()}
    library = Tokenizer.from_file(VOCABULARY)
    assert back == {1: library.decode(library.encode("Hello there", add_special_tokens=False).ids, skip_special_tokens=False), 2: "", 3: ""}


# ---- WARC


def test_round_trip_of_odd_pages(spark):
    large = "é\r\n0\r\nWARC/1.1\r\n" * 60_000
    rows = [(1, "http://a b\n", large), (2, None, large), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", "z" * 1000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string").repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages).collect())
    want = Counter()
    winner = {large: 2, "y" * 1000: 8, "z" * 1000: None}
    for i, _, html in rows:
        html = html or ""
        again = len(html.encode()) >= 1000 and winner[html] != i
        want[i, len(html.encode()), hashlib.sha1(html.encode()).hexdigest(), "revisit" if again else "response", winner[html] if again else None] += 1
    assert got == want
    small = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages, segment_bytes=50, chunk_bytes=7).where("not fault").collect())
    assert small == want
    assert warc.archive_round_trip(pages.where("false")).collect() == []


def test_lost_segments_are_faults(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 300_000)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    records = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert records.where("type = 'continuation'").count() >= 3
    assert [r["fault"] for r in warc.reassembled(records).collect()] == [False]
    for less in ("coalesce(segment, 0) <> 2", "coalesce(segment, 0) <> 1", "coalesce(segment, 0) <> 4"):
        assert [(r["fault"], r["payload_bytes"]) for r in warc.reassembled(records.where(less)).collect()] == [(True, None)]
    assert [r["fault"] for r in warc.reassembled(records.union(records)).collect()] == [True]


def test_the_query_segments_many_pages(spark, medium, tmp_path):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    warc.write_archives(pages, f"file://{tmp_path}/w", segment_bytes=2048, chunk_bytes=1024)
    records = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert records.where("segment = 1").count() > 80


def test_broken_archives(spark, tmp_path):
    """A length that is no number, a segment number that is none, a record cut off, and one without identifier; whole ones around them stay."""
    import gzip

    def record(n, length=None, more=(), body=b"HTTP/1.1 200 OK\r\n\r\nbody\nof two lines"):
        digest = hashlib.sha1(body.partition(b"\r\n\r\n")[2]).hexdigest()
        head = ["WARC/1.1", "WARC-Type: response", f"X-Page-ID: {n}", f"WARC-Payload-Digest: sha1:{digest}", *more, f"Content-Length: {len(body) if length is None else length}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    own = lambda n: f"WARC-Record-ID: <r{n}>"
    files = [[record(1, None, [own(1)]), record(2, "many", [own(2)]), record(3, None, [own(3), "WARC-Segment-Number: x"]), record(4), record(5)], [record(6, None, [own(6)]), record(7, 4000, [own(7)])], [b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 8"]]
    for k, parts in enumerate(files):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["fault"]) for r in warc.archived_pages(warc.read_archives(spark, f"file://{tmp_path}")).collect()}
    right, wrong = (17, "response", False), (None, "response", True)
    assert got == {1: right, 2: wrong, 3: wrong, 4: right, 5: right, 6: right, 7: wrong, 8: wrong}


def test_chunked_framing():
    for n in (0, 1, 16 * 1024, 40_000):
        assert warc.dechunked(warc.chunked(b"a" * n)) == b"a" * n
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


# ---- the pipeline


def test_pipeline_as_brute_force(spark, duck, small):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    kept = {r[0] for r in duck.execute(f"select doc_id from ({queries.OP2_SQL}) where kept").fetchall()}
    by_text = defaultdict(int)
    for i in kept:
        by_text[lower(rows[i]["text"])] = max(by_text[lower(rows[i]["text"])], i)
    left = sorted(by_text.values())
    found = components([(i, rows[i]["text"]) for i in left], 5, 80)
    left = [i for i in left if found[i][1] == i]
    docs = spark.createDataFrame([rows[i] for i in left], spark.read.parquet(f"{small}/documents.parquet").schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(docs).collect()}
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    want = Counter()
    for i, n in copies.items():
        ids = library.encode(rows[i]["text"], add_special_tokens=False).ids
        digest = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want[i, " ".join(map(str, ids)), len(ids), digest] += n
    got = corpus_pipeline.run(spark, small).select("doc_id", "ids", "n_tokens", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == +want and len(left) < len(rows)


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeats and another column; and an empty table."""
    text = " ".join(f"word{i} of a text" for i in range(30))
    rows = [(1, text, "en", "a", 1, "x"), (2, text.upper(), "en", "a", 1, "x"), (3, None, None, None, None, None), (4, "", "en", "a", 0, "x"), (5, text + " more", "de", None, 1, "x"), (None, text + " and other words that are not the same at all " * 9, None, None, 1, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, own string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} <= {2, 5, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_tables_of_stages_go(spark, small):
    """What stages keep for their lazy results goes when these are written."""
    import os

    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    corpus_pipeline.run(spark, small)
    assert len(set(os.listdir(base)) - before) == 1


def test_stages_return_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_faulty_responses_have_no_payload(spark):
    """A response whose second segment is missing, a revisit of it, and a whole response."""
    base = dict(uri="u", segment=None, total=None, refers_to=None, fault=False)
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nhalf", b"HTTP/1.1 200 OK\r\n\r\nwhole", b""]
    digests = [hashlib.sha1(b).hexdigest() for b in (b"half and more", b"whole", b"half and more")]
    own = [dict(type="response", segment=1, page_id=1), dict(type="response", page_id=2), dict(type="revisit", page_id=3, refers_to=1)]
    rows = [base | o | dict(record_id=str(k), origin=str(k), length=len(b), digest=d, block=b) for k, (o, b, d) in enumerate(zip(own, blocks, digests, strict=True))]
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["fault"]) for r in warc.archived_pages(spark.createDataFrame(rows, warc.PARSED)).collect()}
    assert got == {1: (None, None, True), 2: (5, digests[1], False), 3: (None, digests[2], True)}
