"""Text functions: documented examples, class boundaries, and properties over random strings."""

from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morphmill.api import PreTokenizer
from morphmill.functions import text as T

#: text (spaces as sentinels), cut mode, tokens
SPLITS = [
    ("a▁▁b", 0, ["a", "▁", "▁b"]),
    ("hello,,world", 0, ["hello", ",,", "world"]),
    ("▁,a", 0, ["▁,", "a"]),
    (",a", 0, [",a"]),
    ("year▁2024", 0, ["year", "▁", "2024"]),
    ("你好，世界", 0, ["你好", "，", "世界"]),
    ("hi🙂bye", 0, ["hi", "🙂bye"]),
    ("▁$100", 0, ["▁$", "100"]),
    ("100%", 0, ["100", "%"]),
    ("24h", 0, ["24", "h"]),
    ("they'll", 0, ["they", "'ll"]),
    ("", 0, []),
    ("▁", 0, ["▁"]),
    ("▁don't", 1, ["▁", "don't"]),
    ("a▁▁b", 1, ["a", "▁", "▁", "b"]),
    ("hi,,", 1, ["hi", ",", ","]),
    ("汉字a1", 1, ["汉字", "a", "1"]),
    ("don''t", 1, ["don", "'", "'", "t"]),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, expr):
    return [r[1] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_pretokenizer_examples(spark):
    for cut in (0, 1):
        own = [s for s in SPLITS if s[1] == cut]
        assert values(column(spark, [s[0] for s in own]), T.pretokenize(F.col("x"), cut)) == [s[2] for s in own]


def test_unknown_cut_mode():
    with pytest.raises(ValueError):
        T.pretokenizer_pattern(2)


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = "aZé ▁▁  ,.'\t\n09５汉々字カ🙂ªµ٠ﬁ①"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 24))) for _ in range(n)]


@pytest.mark.parametrize("cut", [0, 1])
def test_tokens_join_to_the_text(spark, cut):
    texts = random_texts(2000, cut)
    assert values(column(spark, texts), F.array_join(T.pretokenize(F.col("x"), cut), "")) == texts


def reference_normal(t: str, keep: bool) -> str:
    if keep:
        return t.replace(" ", "▁")
    out = "▁".join(p for p in t.split(" ") if p)
    return out.rstrip("▁")


@pytest.mark.parametrize("keep", [False, True])
def test_normalize(spark, keep):
    texts = random_texts(2000, 5)
    assert values(column(spark, texts), T.normalize(F.col("x"), keep)) == [reference_normal(t, keep) for t in texts]


def test_normalize_is_idempotent(spark):
    once = T.normalize(F.col("x"))
    df = column(spark, random_texts(500, 6))
    assert values(df, once) == values(df, T.normalize(once))


def test_nulls_stay_null(spark):
    df = column(spark, [None, "a b"])
    assert values(df, T.normalize(F.col("x"))) == [None, "a▁b"]
    assert values(df, T.pretokenize(T.normalize(F.col("x")))) == [None, ["a", "▁b"]]
    assert values(df, T.unicode_normalize(F.col("x"), "NFKC")) == [None, "a b"]
    assert values(df, T.map_longest(F.col("x"), {"a": "A"})) == [None, "A b"]


def test_character_classes(spark):
    df = column(spark, ["a", "é", "5", "５", "汉", "㐀", "々", "〇", "ª", "µ", "٠", "カ", " ", "▁", "ー", "ab"])
    assert [x for x, is_ in zip("aé5５汉㐀々〇ªµ٠カ ▁ー?", values(df, T.is_han(F.col("x"))), strict=True) if is_] == ["汉", "㐀"]
    assert [x for x, is_ in zip("aé5５汉㐀々〇ªµ٠カ ▁ー?", values(df, T.is_digit(F.col("x"))), strict=True) if is_] == ["5", "５"]
    assert [x for x, is_ in zip("aé5５汉㐀々〇ªµ٠カ ▁ー?", values(df, T.is_word_char(F.col("x"))), strict=True) if is_] == ["a", "é", "5", "５", "汉", "㐀", "٠", "カ", "ー"]


def test_split_han(spark):
    df = column(spark, ["Tom▁他是英国人Bat", "漢", ""])
    assert values(df, T.split_han(T.pretokenize(F.col("x")))) == [["Tom", "▁", "他", "是", "英", "国", "人", "Bat"], ["漢"], []]


def test_named_normalizers(spark):
    texts = ["①②③", "ﬁne", "ÄB", "Straße", "plain"]
    df = column(spark, texts)
    assert values(df, T.unicode_normalize(F.col("x"), "NMT_NFKC")) == [unicodedata.normalize("NFKC", t) for t in texts]
    assert values(df, T.unicode_normalize(F.col("x"), "NFKC_CF")) == ["123", "fine", "äb", "strasse", "plain"]
    assert values(df, T.unicode_normalize(F.col("x"), "no")) == texts


def test_longest_match_rewrite(spark):
    df = column(spark, ["abcab", "xx", ""])
    assert values(df, T.map_longest(F.col("x"), {"ab": "1", "abc": "2", "": "never"})) == ["21", "xx", ""]
    assert values(df, T.map_longest(F.col("x"), {})) == ["abcab", "xx", ""]


def test_byte_pieces(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("i"), F.col("id").alias("x"))
    assert values(df, T.byte_to_piece(F.col("x"))) == [f"<0x{b:02X}>" for b in range(256)]
    assert values(df, T.piece_to_byte(T.byte_to_piece(F.col("x")))) == list(range(256))
    assert values(column(spark, ["<0x0a>", "a", "<0x100>", None]), T.piece_to_byte(F.col("x"))) == [-1, -1, -1, None]


def test_escapes_of_any_bytes():
    rng = random.Random(3)
    for _ in range(500):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(12)))
        assert T.unescape_bytes(T.escape_bytes(raw)) == raw
    assert T.escape_bytes(b"a\tb\\\xff") == "a\\x09b\\x5C\\xFF"


def test_escape_column(spark):
    texts = ["a\tb", "\\", "\r\n", "é", ""]
    assert values(column(spark, texts), T.escape(F.col("x"))) == [T.escape_bytes(t.encode()) for t in texts]


def test_pretokenizer_api(spark):
    df = column(spark, ["  Hello  world ", "a b"])
    assert values(df, PreTokenizer().tokenize(F.col("x"))) == [["Hello", "▁world"], ["a", "▁b"]]
    assert values(df, PreTokenizer(cut=1, reconstruct=True).tokenize(F.col("x"))) == [["▁", "▁", "Hello", "▁", "▁", "world", "▁"], ["a", "▁", "b"]]


def offsets_slowly(text, reconstruct, space):
    """Character by character: what offsets_of gives, one text at a time."""
    size, at, out, marks = len(space.encode()), 0, [], []
    for c in text:
        if c != " ":
            out.append(c)
            marks += [at] * len(c.encode())
        elif reconstruct or (out and out[-1] != " "):
            out.append(" ")
            marks += [at] * size
        at += len(c.encode())
    end = at
    while not reconstruct and out and out[-1] in (" ", space):
        out.pop()
        del marks[len(marks) - size + 1 :]
        end = marks.pop()
    return "".join(space if c == " " else c for c in out), [*marks, end] if out or (reconstruct and text) else []


@pytest.mark.parametrize("reconstruct", [False, True])
@pytest.mark.parametrize("space", ["▁", "_", "🙂"])
def test_offsets_of_a_batch_are_those_of_each_text(reconstruct, space):
    rng = random.Random(7)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(["a", " ", "  ", "ä", "▁", "_", "他", "🙂", "\t"]) for _ in range(rng.randrange(12))) for _ in range(2000)] + ["", " ", "▁ ▁"]
    for rows in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(7, 900), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        got = [x.to_pylist() for x in T.offsets_of(rows, reconstruct, space)]
        want = [("", []) if t is None else offsets_slowly(t, reconstruct, space) for t in rows.to_pylist()]
        assert got[1] == [w[1] for w in want]
        assert [x or "" for x in got[0]] == [w[0] for w in want]
