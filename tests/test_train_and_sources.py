"""Training against plain sequential trainers, statistics, sources, sinks and streams."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morphmill.model import BYTE_PAIR, CHAR_PAIR, NGRAM, SEQUENCE, TrainSpec
from morphmill.operators import corpus, stats, train
from morphmill.operators.storage import Rounds
from morphmill.plans import catalog, oracles
from morphmill.sources import text as src
from morphmill.streaming.words import stream_lines, stream_tokens, stream_word_counts

WORDS = {"low": 5, "lower": 2, "newest": 6, "widest": 3, "aaaa": 4, "abab": 3, "née": 2, "x": 9}


def words(spark, given=WORDS, parts=1):
    return spark.createDataFrame(list(given.items()), "word string, freq long").repartition(parts)


def random_words(seed: int, alphabet: str = "abcé") -> dict[str, int]:
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 8))): rng.randrange(1, 9) for _ in range(40)}


def merged(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if tuple(ids[i : i + 2]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def byte_pairs_slowly(given: dict[str, int], n: int, most: int) -> list[bytes]:
    own, names = {w: list(w.encode()) for w in given}, [bytes([b]) for b in range(256)]
    while len(names) < n:
        counts = Counter()
        for w, ids in own.items():
            for p in zip(ids, ids[1:], strict=False):
                counts[p] += given[w]
        fit = [(-c, max(p), p) for p, c in counts.items() if len(names[p[0]]) + len(names[p[1]]) <= most]
        if not fit:
            break
        pair = min(fit)[2]
        names.append(names[pair[0]] + names[pair[1]])
        own = {w: merged(ids, pair, len(names) - 1) for w, ids in own.items()}
    return names


@pytest.mark.parametrize("given,most", [(WORDS, 18), (random_words(1), 6)], ids=["plain", "random"])
def test_byte_pairs_as_one_by_one(spark, given, most):
    spec = TrainSpec(BYTE_PAIR, train.stored_size(BYTE_PAIR, 256 + 14), min_count=1, max_piece_size=most)
    model = train.train_byte_pair(words(spark, given, 3), spec, strict=False)
    assert [p.piece for p in model.pieces[3:]] == byte_pairs_slowly(given, 270, most)


def test_too_small_corpus(spark):
    spec = TrainSpec(BYTE_PAIR, 300)
    with pytest.raises(ValueError):
        train.train_byte_pair(words(spark, {"ab": 1}), spec)
    assert len(train.train_byte_pair(words(spark, {"ab": 1}), spec, strict=False).pieces) == 260
    with pytest.raises(ValueError):
        train.train_byte_pair(words(spark), TrainSpec(BYTE_PAIR, 100))


def char_pairs_slowly(given: dict[str, int], budget: int, most: int) -> list[str]:
    own, made, refused, names = {w: list(w) for w in given}, [], set(), {}
    own = {w: [(c,) for c in s] for w, s in own.items()}  # a symbol is the tree of its merges
    flat = lambda s: s[0] if len(s) == 1 else flat(s[0]) + flat(s[1])
    while len(made) < budget:
        counts = Counter()
        for w, s in own.items():
            for p in zip(s, s[1:], strict=False):
                counts[p] += given[w]
        fit = [(-c, len(flat(p)), flat(p).encode(), p) for p, c in counts.items() if p not in refused and len(flat(p).encode()) <= most]
        if not fit:
            break
        pair = min(fit, key=lambda x: x[:3])[3]
        name = flat(pair)
        if name in names:
            refused.add(pair)
            continue
        names[name] = pair
        made.append(name)
        for w, s in own.items():
            out, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == pair:
                    out.append(pair)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            own[w] = out
    return made


def test_char_pairs_as_one_by_one(spark):
    required = len({c for w in WORDS for c in w})
    spec = TrainSpec(CHAR_PAIR, train.stored_size(CHAR_PAIR, required + 8), min_count=1, character_coverage=1.0)
    model = train.train_char_pair(words(spark, parts=2), spec)
    learned = [p.piece.decode() for p in model.pieces[259:]]
    assert learned[:8] == char_pairs_slowly(WORDS, 8, 18)
    assert set(learned[8:]) == {c for w in WORDS for c in w}


def char_pairs_in_order(given: dict[str, int], budget: int, most: int, made: tuple[str, ...] = ()) -> list[str]:
    """Merges one by one over symbols by number, the last thing that decides; strings in ``made`` are passed over."""
    chars = sorted({c for w in given for c in w} | {"▅"})
    names, own = list(chars), {w: [chars.index(c) for c in w] for w in given}
    out, passed = [], set()
    while len(out) < budget:
        counts = Counter()
        for w, ids in own.items():
            for p in zip(ids, ids[1:], strict=False):
                counts[p] += given[w]
        fit = [(-c, len(names[p[0]] + names[p[1]]), (names[p[0]] + names[p[1]]).encode(), p) for p, c in counts.items() if p not in passed]
        fit = [x for x in fit if len(x[2]) <= most]
        if not fit:
            break
        _, _, name, pair = min(fit)
        if name.decode() in {*made, *out}:
            passed.add(pair)
            continue
        out.append(name.decode())
        names.append(out[-1])
        own = {w: merged(ids, pair, len(names) - 1) for w, ids in own.items()}
    return out


def runs(seed: int) -> dict[str, int]:
    """Words of two characters, with runs of one, and many pairs that are as frequent as others."""
    rng = random.Random(seed)
    return {"".join(rng.choice("aab") for _ in range(rng.randrange(2, 16))): rng.randrange(2, 30) for _ in range(25)}


@pytest.mark.parametrize("stretches,links,budget", [(50_000, 50, 1000), (20, 8, 1000), (3, 50, 13), (50_000, 1, 13)])
@pytest.mark.parametrize("given", [runs(1), random_words(11, "abcdé") | WORDS | {"abcaa" * 300 + "née" * 200: 2}], ids=["runs", "plain"])
def test_char_pairs_over_stretches(spark, monkeypatch, given, stretches, links, budget):
    """However many pairs and stretches a round has, merges are those of one by one, to the last pair."""
    monkeypatch.setattr(train, "STRETCHES", stretches)
    monkeypatch.setattr(train, "LINKS", links)
    required = len({c for w in given for c in w})
    spec = TrainSpec(CHAR_PAIR, train.stored_size(CHAR_PAIR, required + budget), min_count=1, character_coverage=1.0, max_piece_size=9)
    learned = [p.piece.decode() for p in train.train_char_pair(words(spark, given, 3), spec).pieces[259:]]
    assert learned[:-required] == char_pairs_in_order(given, budget, 9)


def test_strings_made_before_are_passed_over(spark):
    """Merging left to right makes each string in one way only, so those made before are given here."""
    given, made = random_words(11, "abcdé") | WORDS, ("es", "ab", "low")
    chars = sorted({c for w in given for c in w} | {"▅"})
    with Rounds(spark, "test") as rounds:
        own = train._char_ids(words(spark, given, 2), {c: i for i, c in enumerate(chars)}, chars.index("▅"))
        state = train.CharMerges(own, rounds, chars, chars.index("▅"), 9)
        state.made, state.links = set(made), 8
        while len(state.pieces) < 60 and state.round(60):
            pass
    assert state.pieces == char_pairs_in_order(given, 60, 9, made) and len(state.refused) >= 2


def test_char_pairs_of_few_known_counts(spark, monkeypatch):
    """Pairs that can't be merged take all of the known places: more are asked for."""
    monkeypatch.setattr(train, "KNOWN", 3)
    given = {"abcabcabc": 90, "xyxyxyxyx": 80, **random_words(4)}
    required = len({c for w in given for c in w})
    spec = TrainSpec(CHAR_PAIR, train.stored_size(CHAR_PAIR, required + 300), min_count=1, character_coverage=1.0, max_piece_size=4)
    learned = [p.piece.decode() for p in train.train_char_pair(words(spark, given, 2), spec).pieces[259:]]
    assert learned[:-required] == char_pairs_in_order(given, 300, 4)


def test_stretches_are_of_linked_neighbours():
    flat = np.array([1, 2, 3, -1, 4, -1, 3, 3, 3, 9, 1, 2, -1], np.int64)
    links = np.array(sorted((a << 32) + b for a, b in ((1, 2), (2, 3), (3, 3))), np.int64)
    got = train._stretches(flat, np.array([5, 6, 7]), links)
    assert [(np.frombuffer(r["s"], np.int32).tolist(), r["freq"]) for r in got.to_pylist()] == [([1, 2, 3], 5), ([3, 3, 3], 7), ([1, 2], 7)]


def test_char_pair_sql_as_one_by_one():
    """The SQL's merges, several a step, are those of one by one."""
    for given in (runs(1), runs(2), random_words(11) | {w: 2 * f for w, f in WORDS.items()}):
        given = {w: f for w, f in given.items() if f > 1}
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, text varchar)")
        con.executemany("insert into documents values (?, ?)", [[i, "\n".join([w] * f)] for i, (w, f) in enumerate(given.items())])
        rows = sorted(con.execute(oracles._train_char_pair_sql(1000)).fetchall())
        required = len({c for w in given for c in w})
        assert [bytes.fromhex(r[1]).decode() for r in rows[259:-required]] == char_pairs_in_order(given, 1000, 18)


def test_char_pair_query_trains_all_entries(spark, small, monkeypatch):
    """The 8,000 entries of a model that isn't told otherwise, beside special and byte pieces, in few rounds."""
    made, original = [], train.CharMerges.round
    monkeypatch.setattr(train.CharMerges, "round", lambda self, budget: made.append(0) or original(self, budget))
    got = catalog.queries()["train_char_pair"](spark, small).collect()
    assert 0 < len(made) < 12
    assert sorted(r["id"] for r in got) == list(range(8259)) and len({r["piece"] for r in got}) == 8259


def test_ngram_training(spark):
    spec = TrainSpec(NGRAM, train.stored_size(NGRAM, 50), min_count=2)
    one = train.train_ngram(words(spark, parts=1), spec)
    again = train.train_ngram(words(spark, parts=5), spec)
    assert one.pieces == again.pieces and one.spec.vocab_size == len(one.pieces)
    scores = [p.score for p in one.pieces[259:]]
    assert scores == sorted(scores, reverse=True) and min(scores) >= 1


def cuts_at_characters(text: bytes) -> list[list[bytes]]:
    """All ways to cut a text between its characters."""
    chars = [c.encode() for c in text.decode()]
    ways = [[]]
    for i, c in enumerate(chars):
        ways = [w + [c] for w in ways] + ([w[:-1] + [w[-1] + c] for w in ways] if i else [])
    return ways


def only_best(ways: list[list[bytes]], score) -> list[bytes]:
    """The way of the highest score; the fixtures have no near ties, which rounding could turn."""
    ranked = sorted(((score(w), w) for w in ways), reverse=True)
    assert len(ranked) == 1 or ranked[0][0] - ranked[1][0] > 1e-7
    return ranked[0][1]


def ngram_pieces_slowly(given: dict[str, int], spec: TrainSpec, slots: int) -> list[tuple[bytes, int]]:
    """Byte n-gram model, best cuts out of all cuts, pruning until the number of pieces stays the same."""
    grams: Counter = Counter()
    for word, n in given.items():
        own = word.encode()
        for i in range(len(own)):
            for j in range(i + 1, min(i + 6, len(own)) + 1):
                grams[own[i:j]] += n
    grams = Counter({g: n for g, n in grams.items() if len(g) == 1 or n >= spec.min_count})
    for b in range(256):
        grams[bytes([b])] = grams[bytes([b])] or 1
    total = sum(n for g, n in grams.items() if len(g) == 1)

    def logp(gram: bytes) -> float:
        return math.log(grams[gram] / (grams[gram[:-1]] if len(gram) > 1 else total)) if grams[gram] else -math.inf

    def under_ngrams(way: list[bytes]) -> float:
        return sum(logp(piece[max(0, i - 5) : i + 1]) for piece in way for i in range(len(piece)))

    def counted(rows: dict, score) -> Counter:
        out: Counter = Counter()
        for text, n in rows.items():
            for piece in only_best(cuts_at_characters(text), score):
                out[piece] += n
        return out

    def again(rows: dict, kept: dict) -> Counter:
        whole = sum(kept.values())

        def weight(piece: bytes) -> float:
            entry = math.log(kept[piece] / whole) if piece in kept else -math.inf
            return max(entry, -10.0) if len(piece.decode()) == 1 else entry

        return counted(rows, lambda way: sum(map(weight, way)))

    counts = counted({w.encode(): n for w, n in given.items()}, under_ngrams)
    kept = {p: n for p, n in counts.items() if len(p) <= spec.max_piece_size and n >= spec.min_count}
    rest = {p: n for p, n in counts.items() if p not in kept}
    kept = Counter(kept) + again(rest, kept)
    while True:
        size = len(kept)
        kept = again(kept, kept)
        if len(kept) == size:
            break
    best = sorted(kept.items(), key=lambda x: (len(x[0]) > 1, -x[1], -len(x[0]), x[0]))[:slots]
    return sorted(best, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("seed,alphabet,least,longest,slots", [(1, "abcdefg", 150_000, 18, 500), (1, "aéb中cü", 1, 4, 500), (1, "abécd", 1, 3, 9)], ids=["rare", "long", "full"])
def test_ngram_training_as_one_by_one(spark, seed, alphabet, least, longest, slots):
    rng = random.Random(seed)  # no character twice in a word: runs would be cut in several ways of one score
    given = {"".join(rng.sample(alphabet, rng.randrange(1, len(alphabet) + 1))): rng.randrange(1, 100_000) for _ in range(40)}
    spec = TrainSpec(NGRAM, train.stored_size(NGRAM, slots), min_count=least, max_piece_size=longest)
    learned = [(p.piece, int(p.score)) for p in train.train_ngram(words(spark, given, 3), spec).pieces[259:]]
    assert learned == ngram_pieces_slowly(given, spec, slots)
    assert any(len(p.decode()) > 1 for p, _ in learned)


def test_ngram_training_by_joins(spark, small):
    """Tables too large to be sent are joined by blocks of words, to the same pieces."""
    counts = stats.word_counts(stats.words_of(src.lines_of(spark.read.parquet(f"{small}/documents.parquet"), "text", "doc_id")))
    spec = TrainSpec(NGRAM, train.stored_size(NGRAM, 400), min_count=4)
    sent, joined = (train.train_ngram(counts, spec, most_sent=n) for n in (None, 0))
    assert sent.pieces == joined.pieces and len(sent.pieces) > 400


def test_pieces_of_long_and_empty_words(spark):
    """Words of all lengths in one table, an empty one among them, in every block."""
    given = words(spark, {"": 3, "a": 2, "ab" * 5000: 1, "né" * 30: 4, **random_words(3)}, 2)
    sent, joined = (sorted((bytes(r["piece"]), r["cnt"]) for r in train.ngram_segments(given, 1, n).collect()) for n in (None, 0))
    assert sent == joined and sum(len(p) * n for p, n in sent) == sum(len(r["word"].encode()) * r["freq"] for r in given.collect())


@pytest.mark.parametrize("known,behind", [(40, 48), (100_000, 3), (25, 2)])
def test_counts_of_pairs_are_kept_up_to_date(spark, monkeypatch, known, behind):
    """Few known pairs and an index that is made anew often give the merges of one by one."""
    monkeypatch.setattr(train, "KNOWN", known)
    monkeypatch.setattr(train, "BEHIND", behind)
    given = random_words(7, "abcdé") | WORDS
    spec = TrainSpec(BYTE_PAIR, train.stored_size(BYTE_PAIR, 256 + 40), min_count=1, max_piece_size=7)
    model = train.train_byte_pair(words(spark, given, 3), spec, strict=False)
    assert [p.piece for p in model.pieces[3:]] == byte_pairs_slowly(given, 296, 7)


def test_rounds_touch_fewer_words(spark, small):
    """Later merges are of rarer pairs: a round changes fewer counts for each merge."""
    seen = []
    original = train.PairCounts.merge

    def merge(self, pairs):
        original(self, pairs)
        seen.append((len(pairs), self.touched[-1]))

    train.PairCounts.merge = merge
    try:
        counts = stats.word_counts(stats.words_of(src.lines_of(spark.read.parquet(f"{small}/documents.parquet"), "text", "doc_id")), min_count=2)
        train.train_byte_pair(counts, TrainSpec(BYTE_PAIR, train.stored_size(BYTE_PAIR, 256 + 300)))
    finally:
        train.PairCounts.merge = original
    first, last = seen[:5], seen[-5:]
    per = lambda rounds: sum(t for _, t in rounds) / sum(n for n, _ in rounds)
    assert per(last) < per(first)


def test_sequence_training(spark):
    lines = spark.createDataFrame([(0, "aaaa"), (1, ""), (2, "abab")], "n int, line string")
    model = train.train_sequence(lines, TrainSpec(SEQUENCE, 259), "n")
    # "aaaa\nabab\n": aa occurs 3 times with overlaps, then ab twice; after that no pair occurs twice
    assert [p.piece for p in model.pieces[256:]] == [b"aa", b"ab"]
    with pytest.raises(ValueError):
        train.train_sequence(lines, TrainSpec(SEQUENCE, 256), "n")


def test_frequencies_add_up(spark, small):
    lines = src.lines_of(spark.read.parquet(f"{small}/documents.parquet"), "text", "doc_id")
    tokens = stats.words_of(lines)
    assert stats.word_counts(tokens).agg(F.sum("freq")).first()[0] == tokens.count()


def test_counts_do_not_depend_on_partitions(spark):
    lines = spark.createDataFrame([(i, "the cat and the hat") for i in range(50)], "i int, line string")
    one, many = (sorted(stats.word_counts(stats.words_of(lines.repartition(n))).collect()) for n in (1, 7))
    assert one == many


def test_coverage_and_unknown(spark):
    chars = stats.char_counts(words(spark, {"aaab": 10, "c": 1}))
    assert {r["char"]: r["cnt"] for r in chars.collect()} == {"a": 30, "b": 10, "c": 1}
    kept = stats.covered_chars(chars, 0.9)
    assert sorted(r["char"] for r in kept.collect()) == ["a", "b"]
    assert sorted(r["word"] for r in stats.with_unknown(words(spark, {"abc": 1, "cc": 2}), kept).collect()) == ["ab▅", "▅▅"]


def test_pairs_count_overlaps(spark):
    pairs = stats.pair_counts(words(spark, {"aaa": 2, "b": 5}), stats.characters(F.col("word")))
    assert [tuple(r) for r in pairs.collect()] == [("a", "a", 4)]


def test_empty_inputs(spark):
    lines = spark.createDataFrame([], "i int, line string")
    counts = stats.word_counts(stats.words_of(lines))
    assert counts.count() == 0 and stats.char_counts(counts).count() == 0
    assert stats.pair_counts(counts, stats.bytes_of(F.col("word"))).count() == 0
    assert stats.byte_ngrams(counts).count() == 0
    assert stats.ngram_logprobs(stats.byte_ngrams(counts)).count() == 256


def test_corpus_preparation(spark):
    rows = spark.createDataFrame([(0, "# Title\nSome  text.\n\n#\nlost\nEnd"), (1, "  　 "), (2, None), (3, "Hi! How? 好。吗 3.5 ok.")], "i int, text string")
    cleaned = {r["i"]: r["text"] for r in corpus.clean_documents(rows).collect()}
    assert cleaned == {0: "Some text. End", 3: "Hi! How? 好。吗 3.5 ok."}
    found = {r["i"]: r["s"] for r in rows.select("i", corpus.sentences(F.col("text")).alias("s")).collect()}
    assert found[3] == ["Hi!", "How?", "好。", "吗 3.5 ok."] and found[2] is None and found[1] == []


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\ntwo\n")
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\n\n{"text": ""}\n{"title": "t"}\n{"text": "y z"}\n')
    assert sorted(r["line"] for r in src.read_lines(spark, f"file://{tmp_path}/a.txt").collect()) == ["", "one\r", "two"]
    assert sorted(r["text"] for r in src.read_articles(spark, f"file://{tmp_path}/b.jsonl").collect()) == ["x", "y z"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.read_lines(spark, f"file://{tmp_path}/none.txt")
    some = spark.createDataFrame([(0, 0, "a"), (0, 1, ""), (0, 2, "b"), (1, 0, "c")], "f int, n int, line string")
    assert [r["line"] for r in src.first_lines(some, 2, "f", "n").collect()] == ["a", "b"]
    assert src.first_lines(some, 0, "f", "n").count() == 3


def test_encoded_lines(spark):
    rows = spark.createDataFrame([(0, ["a", "b"], [1, 2]), (1, [], [])], "i int, pieces array<string>, ids array<int>")
    assert [r["value"] for r in src.encoded_lines(rows, "i").orderBy("i", "n").collect()] == ["a\t1", "b\t2", "", ""]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("the cat\nthe hat\n")
    lines = stream_lines(spark, f"file://{folder}")
    query = stream_word_counts(lines).writeStream.format("memory").queryName("words").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/one").start()
    tokens = stream_tokens(lines).writeStream.format("memory").queryName("tokens").option("checkpointLocation", f"file://{tmp_path}/two").start()
    try:
        query.processAllAvailable()
        tokens.processAllAvailable()
        assert {tuple(r) for r in spark.sql("select * from words").collect()} == {("the", 2), ("▁cat", 1), ("▁hat", 1)}
        assert spark.sql("select * from tokens").count() == 2
    finally:
        query.stop()
        tokens.stop()


def test_texts_are_counted_once_for_all_uses(spark, tmp_path):
    """What a trainer, or n-grams' probabilities, use several times comes from whole texts: it is computed once."""
    lines = spark.createDataFrame([("the other thing and the end",)] * 40, "line string").repartition(1)
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def used(then):
        before = seen.value
        then(lines.mapInArrow(told, lines.schema))
        return seen.value - before

    assert used(lambda x: train.train_char_pair(stats.word_counts(stats.words_of(x)), TrainSpec(CHAR_PAIR, 259 + 20, min_count=1))) == 40
    assert used(lambda x: train.train_ngram(stats.word_counts(stats.words_of(x)), TrainSpec(NGRAM, 300, min_count=1))) == 40
    assert used(lambda x: stats.ngram_logprobs(stats.byte_ngrams(stats.word_counts(stats.words_of(x))), 2).collect()) == 40


def test_index_lists_each_word_once_under_each_pair(monkeypatch):
    monkeypatch.setattr(train, "SLICE", 7)
    words = [[1, 1, 1, 2], [3, 1], [5], [1, 2, 1, 2, 1]]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array([4, 5, 6, 7], pa.int64())], ["t", "freq"])
    got = [r for b in train._listed(iter([batch])) for r in b.to_pylist()]
    want = [((a << 32) + b, w, f) for w, f in zip(words, (4, 5, 6, 7)) for a, b in sorted(set(zip(w, w[1:])))]
    assert [(r["pair"], r["t"], r["freq"]) for r in got] == want
    assert all(r["part"] == ((r["pair"] >> 32) * 31 + (r["pair"] & 0xFFFFFFFF)) % train.PARTS for r in got)
