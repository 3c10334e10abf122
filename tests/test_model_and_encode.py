"""Models, their text format, encoding and decoding."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morphmill.api import Tokenizer
from morphmill.functions.batches import in_slices
from morphmill.functions.text import escape_bytes
from morphmill.model import BYTE_PAIR, CHAR_PAIR, NGRAM, SEQUENCE, Model, NormalizerSpec, Piece, TrainSpec, byte_pieces, layout
from morphmill.operators import encode, segment
from morphmill.operators.han import dictionary_of, fingerprint, split_lines
from morphmill.operators.segment import Unigram, merge_chars, merge_ids, ngram_cuts, unspanned
from morphmill.plans.catalog import byte_pair_model, char_pair_model, ngram_model, sequence_model
from morphmill.sources import text as src

MODELS = {BYTE_PAIR: byte_pair_model, CHAR_PAIR: char_pair_model, NGRAM: ngram_model, SEQUENCE: sequence_model}
TEXTS = ["", " ", "the thing there", "  two  spaces ", "Ünï çödé", "then\tand", "汉字 the", "aaaa", None]


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(list(enumerate(rows)), "i int, text string")


@pytest.mark.parametrize("make", MODELS.values(), ids=MODELS)
def test_text_format_round_trip(make):
    model = make()
    back = Model.from_text(model.to_text())
    assert back.spec == model.spec and back.normalizer == model.normalizer
    assert [(p.piece, p.type, p.u, p.v) for p in back.pieces] == [(p.piece, p.type, p.u, p.v) for p in model.pieces]


def test_text_format_errors():
    text = byte_pair_model().to_text()
    with pytest.raises(ValueError):
        Model.from_text(text.replace("size=", "size=1"))
    with pytest.raises(ValueError):
        Model.from_text(text + "1\ttwo\n")
    with pytest.raises(ValueError):
        Model.from_text("")
    with pytest.raises(ValueError):
        TrainSpec(method="other")


def test_model_files(spark, tmp_path):
    path = src.write_model(spark, byte_pair_model(), f"file://{tmp_path}/m")
    assert src.read_model(spark, path).pieces == byte_pair_model().pieces
    assert spark.read.parquet(f"file://{tmp_path}/m.vocabulary").count() == len(byte_pair_model().pieces)


def test_control_tokens():
    model = byte_pair_model()
    more = model.with_control_tokens(["<x>", "<pad>"])
    assert more.spec.pad_id == len(model.pieces) + 1 and more.spec.vocab_size == len(more.pieces)
    with pytest.raises(ValueError):
        model.with_control_tokens([])
    with pytest.raises(ValueError):
        Model(model.spec, model.normalizer, model.pieces[:-1]).with_control_tokens(["<x>"])


def test_layout():
    meta = {0: Piece(b"<unk>"), 2: Piece(b"<s>")}
    assert [p.piece for p in layout(meta, [Piece(b"a"), Piece(b"b")], 4)] == [b"<unk>", b"a", b"<s>", b"b"]
    with pytest.raises(ValueError):
        layout(meta, [], 4, strict=True)
    assert len(byte_pieces()) == 256


@pytest.mark.parametrize("make", MODELS.values(), ids=MODELS)
def test_decode_of_encode(spark, make):
    """For covered text, decoding gives the normalised text with spaces, or for the sequence method the text itself."""
    model = make()
    rows = texts(spark)
    own = rows.select("i", F.transform(encode.encode(F.col("text"), model), lambda x: x["id"]).alias("ids"))
    got = {r["i"]: r["text"] for r in encode.decode(own, model, "i").collect()}
    plain = model.spec.method == SEQUENCE
    want = {i: "" if t is None else t if plain else " ".join(t.split(" ")) if False else t for i, t in enumerate(TEXTS)}
    if not plain:
        want = {i: " ".join(x for x in (t or "").split(" ") if x) for i, t in enumerate(TEXTS)}
    assert got == want


def merged_slowly(ids, ranks):
    ids = list(ids)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        if not pairs:
            return ids
        rank, i = min(pairs)
        ids[i : i + 2] = [rank]


def test_merges_as_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        ranks, n = {}, 4
        for new in range(4, 14):
            ranks.setdefault((rng.randrange(n), rng.randrange(n)), new)
            n = new + 1
        ids = [rng.randrange(4) for _ in range(rng.randrange(20))]
        assert merge_ids(ids, ranks) == merged_slowly(ids, ranks)


def chars_merged_slowly(text, scores):
    parts = list(text)
    while True:
        found = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_char_merges_as_one_by_one():
    rng = random.Random(2)
    for _ in range(300):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -float(i) for i in range(20)}
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(15)))
        assert merge_chars(text, scores) == chars_merged_slowly(text, scores)


def test_unigram_examples():
    english = {w.encode(): s for w, s in (("hello", 10.0), ("world", 10.0), (" ", 5.0), ("h", 0.1), ("ell", 0.5), ("wor", 0.5), ("ld", 0.5))}
    assert Unigram(english).cut(b"hello world") == [b"hello", b" ", b"world"]
    han = {w.encode(): s for w, s in (("我们", 9.0), ("在", 5.0), ("学习", 8.0), ("我", 1.0), ("们", 0.1), ("学", 1.0), ("习", 0.1))}
    assert [p.decode() for p in Unigram(han).cut("我们在学习未知".encode())] == ["我们", "在", "学习", "未", "知"]
    assert Unigram({}).cut(b"") == []


def all_cuts(text):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in all_cuts(text[i:]):
            yield [text[:i], *rest]


def test_unigram_is_the_best_cut():
    rng = random.Random(4)
    for _ in range(60):
        scores = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))).encode(): rng.random() for _ in range(5)}
        model = Unigram(scores)
        text = bytes(rng.choice(b"abc") for _ in range(7))
        weigh = lambda cut: sum(max(model.weights.get(p, -1e9), model.fallback if len(p) == 1 else -1e9) for p in cut)  # noqa: B023, E731
        assert abs(weigh(model.cut(text)) - max(map(weigh, all_cuts(text)))) < 1e-9


def test_ngram_cuts_join_to_the_text():
    rng = random.Random(5)
    table = {bytes([b]): -5.0 for b in range(256)} | {b"ab": -0.1, b"abc": -0.1, "é".encode(): -0.2}
    for _ in range(200):
        text = "".join(rng.choice("abcé汉") for _ in range(rng.randrange(12))).encode()
        cuts = ngram_cuts(text, table)
        assert b"".join(cuts) == text
        for c in cuts:
            c.decode()


def test_duplicate_pieces_take_the_highest_id(spark):
    pieces = (Piece(b"<unk>", type=2), Piece(b"a"), Piece(b"b"), Piece(b"a"))
    vocabulary = Model(TrainSpec(), NormalizerSpec(), pieces).vocabulary(spark)
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "piece string").select(F.encode("piece", "UTF-8").alias("piece"))
    assert {bytes(r["piece"]): r["id"] for r in encode.piece_ids(rows, vocabulary, 0).collect()} == {b"a": 3, b"b": 2, b"c": 0}


def test_decoding_of_strange_ids(spark):
    model = byte_pair_model()
    rows = spark.createDataFrame([(1, [0, 1, 68, 99999]), (2, []), (3, None), (4, [3 + 0xC3])], "i int, ids array<int>")
    got = {r["i"]: r["text"] for r in encode.decode(rows, model, "i").collect()}
    assert got == {1: "A<unk>", 2: "", 3: "", 4: "�"}


def test_tokenizer_api(spark, tmp_path):
    path = src.write_model(spark, byte_pair_model(), f"file://{tmp_path}/api")
    tok = Tokenizer.load(spark, path)
    assert tok.method == BYTE_PAIR and tok.vocab_size() == len(byte_pair_model().pieces)
    assert tok.id_to_piece(tok.piece_to_id("the")) == "the" and tok.piece_to_id("nowhere") == 0
    row = texts(spark, ["the ring"]).select(tok.encode_as_pieces(F.col("text")).alias("p"), tok.encode_as_ids(F.col("text")).alias("ids")).first()
    assert [bytes(p) for p in row["p"]][:1] == [b"the"] and len(row["p"]) == len(row["ids"])
    han = Tokenizer.load(spark, path, "no").with_encoded(texts(spark, ["汉字 the"]), "text").first()
    assert b"".join(bytes(x["piece"]) for x in han["encoded"]).decode() == "汉字▁the"


def test_han_dictionary(spark):
    lines = [(0, "英国\t5"), (1, "英国\t9"), (2, "bad"), (3, "人\t"), (4, "国人\t2.5x"), (5, "他\t-1"), (6, "是\t1e1")]
    words = src.parse_dictionary(spark.createDataFrame(lines, "line_no int, line string"))
    assert dictionary_of(words) == {"英国".encode(): 5.0, "国人".encode(): 2.5, "是".encode(): 10.0}
    assert fingerprint(words) == fingerprint(words.repartition(3))
    rows = spark.createDataFrame([(0, "Tom▁他是英国人Bat"), (1, ""), (2, "ab")], "i int, line string")
    got = {r["i"]: r["tokens"] for r in split_lines(rows, dictionary_of(words)).collect()}
    assert got == {0: ["Tom", "▁", "他", "是", "英国", "人", "Bat"], 1: [], 2: ["ab"]}


@pytest.mark.parametrize("make", MODELS.values(), ids=MODELS)
def test_parts_encode_as_whole_texts(make):
    """Encoding part by part, with what is known, against the whole text at once."""
    rng = random.Random(6)
    own = encode._Lookups(make())
    for _ in range(600):
        text = "".join(rng.choice(["the", "in", "g", "an", "d", "l", "ll", "e", "▁", " ", "é", "汉", "Z"]) for _ in range(rng.randrange(15)))
        assert [own.items[k] for k in own.encode(text)] == own._whole(text, False)[0]


def test_pieces_over_marks_forbid_parts():
    assert unspanned([b"ab", "▁ab".encode(), "▁".encode()], "▁".encode())
    assert not unspanned(["a▁".encode()], "▁".encode())
    assert not unspanned([b"a\xe2\x96"], "▁".encode()) and not unspanned(["▁▁".encode()], "▁".encode())
    learned = [Piece(bytes([b]), 0.0, 6) for b in range(256)] + [Piece(b"e ", -1.0, 1, b"e", b" "), Piece(b"e t", -2.0, 1, b"e ", b"t")]
    own = encode._Lookups(Model(TrainSpec(SEQUENCE, len(learned)), NormalizerSpec(space=""), tuple(learned)))
    assert not own.cuts and [own.items[k][1] for k in own.encode("the the")] == [116, 104, 257, 104, 101]


@pytest.mark.parametrize("make", MODELS.values(), ids=MODELS)
def test_models_with_control_tokens(spark, make):
    """Added control tokens are never made by encoding, and decode to nothing but in the sequence method, where all pieces are text."""
    model = make().with_control_tokens(["<user>", "<system>"])
    rows = texts(spark, ["the thing"])
    ids = rows.select("i", F.transform(encode.encode(F.col("text"), model), lambda x: x["id"]).alias("ids"))
    plain = rows.select("i", F.transform(encode.encode(F.col("text"), make()), lambda x: x["id"]).alias("ids"))
    assert ids.collect() == plain.collect()
    more = ids.select("i", F.concat("ids", F.array(F.lit(len(model.pieces) - 1))).alias("ids"))
    assert encode.decode(more, model, "i").first()["text"] == "the thing" + ("<system>" if model.spec.method == SEQUENCE else "")


def test_decoding_keeps_rows_and_needs_no_shuffle(spark):
    model = byte_pair_model()
    rows = spark.createDataFrame([(1, [68]), (1, [69]), (1, [None, 70])], "i int, ids array<int>")
    out = encode.decode(rows, model, "i")
    assert [r["text"] for r in out.collect()] == ["A", "B", "C"]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [byte_pair_model, char_pair_model, ngram_model, sequence_model])
def test_batches_of_many_slices_are_encoded_as_texts_alone(make):
    """Parts taken together, slices and nulls give what each text gives alone, in bounded slices."""
    rng, sizes = random.Random(5), []
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(["the", "lll", "and", "▁", " ", "ä", "他", "x", "ing", "🙂"]) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "▁", "▁▁the", "the" * 4000]
    own, alone = encode._Lookups(make()), encode._Lookups(make())

    def some(rows):
        sizes.append(len(rows))
        return own.encode_all(rows)

    got = in_slices(pa.array(texts, pa.string()), some, 500).to_pylist()
    assert len(sizes) > 10
    assert [[own.items[k] for k in x] for x in got] == [[alone.items[k] for k in alone.encode(t)] if t else [] for t in texts]


def test_short_texts_merge_as_long_ones(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(300)]
    scores = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): float(rng.randrange(4)) for _ in range(30)}
    ranks = {(rng.randrange(12), rng.randrange(12)): i for i in range(3, 12) for _ in range(2)}
    ids = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(300)]
    short = [merge_chars(t, scores) for t in texts], [merge_ids(x, ranks) for x in ids]
    monkeypatch.setattr(segment, "SHORT", -1)
    assert short == ([merge_chars(t, scores) for t in texts], [merge_ids(x, ranks) for x in ids])


def test_lines_of_tokens_are_those_of_arrays(spark):
    texts = ["the other\\ land\t", "", None, " ", "ä他 singing"]
    for make in (byte_pair_model, char_pair_model, ngram_model):
        model = make()
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
            encode.encode(F.col("t"), model).alias("e"), encode.encode_ids(F.col("t"), model).alias("i"), encode.tokenize(F.col("t"), model).alias("p"),
            encode.token_line(F.col("t"), model).alias("l"), encode.token_line(F.col("t"), model, encode.in_hex, "", fallen=True).alias("h"),
            encode.token_spans(F.col("t"), model).alias("s"), encode.span_line(F.col("t"), model).alias("sl"),
        ).collect()
        for t, r in zip(texts, rows):
            if t is None:
                assert all(x is None for x in r)
                continue
            assert r["i"] == [x["id"] for x in r["e"]]
            assert r["l"] == " ".join(escape_bytes(bytes(p)) for p in r["p"])
            assert r["h"] == "".join(f"<{bytes(x['piece']).hex().upper()}>" for x in r["e"])
            assert r["sl"]["spans"] == ",".join(f"{x['start']}:{x['end']}" for x in r["s"])
            assert bytes(r["sl"]["text"]) == b"".join(t.encode()[x["start"] : x["end"]] for x in r["s"])
