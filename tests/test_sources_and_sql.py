"""Numbered lines, data sources, SQL functions, as-of ranks, rewriting, spans, and what tables are spread."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from morphmill.functions import sql
from morphmill.functions import text as T
from morphmill.model import BYTE_PAIR, CONTROL, Model, NormalizerSpec, Piece, TrainSpec
from morphmill.operators import encode, han
from morphmill.plans import catalog
from morphmill.plans.examples import byte_pair_model, char_pair_model, ngram_model, sequence_model
from morphmill.sources import models
from morphmill.sources import text as src


def test_numbers_are_those_of_reading_in_order(spark, tmp_path):
    rng = random.Random(4)
    paths, want = [], []
    for k in (2, 0, 1):
        lines = [rng.choice(["", f"line {k} {i}", "x" * rng.randrange(200)]) for i in range(3000)]
        (tmp_path / f"{k}.txt").write_text("\n".join(lines))
        paths.append(f"{tmp_path}/{k}.txt")
        want += [x for x in lines if x]
    (tmp_path / "empty.txt").write_text("")
    sizes = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        got = src.numbered_lines(spark, [*paths, f"{tmp_path}/empty.txt"])
        assert spark.read.option("lineSep", "\n").text(paths).rdd.getNumPartitions() > 10
        assert [r["line"] for r in sorted(got.collect())] == want
        assert sorted(r["number"] for r in got.collect()) == list(range(len(want)))
        assert [r["line"] for r in sorted(got.where("number < 7").collect())] == want[:7]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for key in sizes:
            spark.conf.unset(key)
    assert "Sort [" not in plan


def test_model_file_source(spark, tmp_path):
    """Pieces of any bytes come back; ids are checked; a failed write leaves nothing."""
    odd = Model(TrainSpec(BYTE_PAIR, 4), NormalizerSpec(), (Piece(b"\xff\t", -1.5), Piece(b"a\\\nb", 2.0, CONTROL), Piece("▁é".encode(), 0.0, 1, b"\xe2", b"x"), Piece(b"", 1e7)))
    for k, model in enumerate((odd, byte_pair_model(), char_pair_model())):
        path = f"{tmp_path}/{k}/words.model"
        models.save_model(spark, model, path)
        assert sorted(models.load_vocabulary(spark, path).collect()) == sorted(model.vocabulary(spark).collect())
        assert [x.name for x in (tmp_path / str(k)).iterdir()] == ["words.model"]
        again = Model.from_text((tmp_path / str(k) / "words.model").read_text(errors="surrogateescape"))
        assert again.spec == model.spec and again.normalizer == model.normalizer and again.pieces == model.pieces
    with pytest.raises(Exception, match="ids of a vocabulary"):
        odd.vocabulary(spark).where("id <> 1").write.format("subword_model").mode("overwrite").save(f"{tmp_path}/bad/x.model")
    assert list((tmp_path / "bad").iterdir()) == []
    with pytest.raises(Exception, match="there already"):
        odd.vocabulary(spark).write.format("subword_model").mode("append").save(f"{tmp_path}/0/words.model")
    with pytest.raises(Exception):
        models.load_vocabulary(spark, f"{tmp_path}/none.model").collect()


def test_dictionary_source(spark, tmp_path):
    (tmp_path / "d").write_text("英国\t5\n英国\t9\nbad\n\t3\n人\t\n零\t0\n国人\t2.5x\n\n他\t-1\n是\t1e1")
    assert sorted(tuple(r) for r in models.read_dictionary(spark, f"{tmp_path}/d").collect()) == [("国人", 2.5), ("是", 10.0), ("英国", 5.0)]


@pytest.mark.parametrize("make", [byte_pair_model, char_pair_model, ngram_model, sequence_model])
def test_sql_functions_as_columns(spark, small, make):
    model = make()
    names = sql.register(spark, model)
    assert {"normalize_line", "encode_pieces", "pieces_of"} <= set(names)
    lines = src.lines_of(spark.read.parquet(f"{small}/documents.parquet"), "text", "doc_id").limit(400).union(spark.createDataFrame([(-1, 0, "  a  b ▁"), (-2, 0, ""), (-3, 0, None)], "doc_id long, line_no int, line string"))
    lines.createOrReplaceTempView("own_lines")
    text = encode.decoded(F.transform(encode.encode(F.col("line"), model), lambda x: x["id"]), model)
    want = lines.select("line", T.normalize(F.col("line")).alias("n"), T.pretokenize(T.normalize(F.col("line")), 1).alias("t"), encode.encode(F.col("line"), model).alias("e"), F.when(F.col("line").isNotNull(), text).alias("d"))
    got = spark.sql("SELECT line, normalize_line(line) AS n, pretokenize(normalize_line(line), 1) AS t, encode_pieces(line) AS e, CASE WHEN line IS NOT NULL THEN decode_ids(encode_ids(line)) END AS d FROM own_lines")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    rows = spark.sql("SELECT l.doc_id, l.line_no, p.* FROM own_lines l, LATERAL pieces_of(l.line) p")
    flat = lines.select("doc_id", "line_no", F.posexplode(encode.encode(F.col("line"), model)).alias("pos", "p")).select("doc_id", "line_no", "pos", "p.piece", "p.id")
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, flat.collect()))


def test_the_table_function_needs_no_join(spark, small):
    plan = catalog.queries()["sql_pieces"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_ranks_as_of_their_rows(spark):
    rng = random.Random(9)
    for _ in range(3):
        pieces = [Piece(rng.choice([b"a", b"b", b"ab", b"c", b"\xff"]), 0.0, 1, *(rng.choice([b"a", b"b", b"ab", b"c", b"", b"z"]) for _ in range(2))) for _ in range(60)]
        model = Model(TrainSpec(BYTE_PAIR, 60), NormalizerSpec(), tuple(pieces))
        got = {(r["l"], r["r"]): r["id"] for r in encode.rank_table(model.vocabulary(spark).repartition(3)).collect()}
        assert got == encode.merge_ranks(model)


def test_ranks_of_a_large_vocabulary(spark):
    """240,000 rows, many of them again and again."""
    n = 240_000
    rows = spark.range(n).select(F.col("id").cast("int").alias("id"), *(F.encode(F.expr(f"cast(pmod(xxhash64(id, {k}), {m}) as string)"), "UTF-8").alias(c) for k, (c, m) in enumerate((("piece", 5000), ("u", 6000), ("v", 6000)))))
    got = {(r["l"], r["r"]): r["id"] for r in encode.rank_table(rows).collect()}
    pieces = [Piece(bytes(r["piece"]), 0.0, 1, bytes(r["u"]), bytes(r["v"])) for r in rows.orderBy("id").collect()]
    assert got == encode.merge_ranks(Model(TrainSpec(BYTE_PAIR, n), NormalizerSpec(), tuple(pieces))) and len(got) > 100_000


def test_longest_entries_are_replaced(spark, small):
    """As by an alternation of all entries, the longest first; with a table of ten thousand entries."""
    rng = random.Random(2)
    tables = [{"a": "1", "ab": "2", "abc": "", "b": "ab", "ß": "ss", "xyz": "!", "": "never"}]
    tables += [{"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 7))): str(k) for k in range(10_000)}]
    texts = ["", "abcabxyaxyzb", "ßa" * 3, *("".join(rng.choice("abc xyzß") for _ in range(300)) for _ in range(30))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for table in tables:
        pattern = re.compile("|".join(map(re.escape, sorted((k for k in table if k), key=lambda k: -len(k)))))
        want = [pattern.sub(lambda m: table[m[0]], t) for t in texts]  # noqa: B023
        assert [r[0] for r in rows.select(T.map_longest(F.col("t"), table)).collect()] == [*want, None]
        given = spark.createDataFrame([*table.items(), ("a", "zzz"), (None, "x")], "k string, v string")
        assert [r[0] for r in rows.select(T.map_longest(F.col("t"), given)).collect()] == [*want, None]
    assert rows.select(T.map_longest(F.col("t"), {}).alias("t")).collect() == rows.collect()


def test_rewritten_documents_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = catalog.stats.word_counts(catalog.stats.words_of(src.lines_of(docs, "text", "doc_id")))
    words = [r["word"] for r in sorted(counts.where("length(word) > 2").collect(), key=lambda r: (-r["freq"], r["word"].encode()))][:10_000]
    table = {w: f"<{w[::-1]}>" for w in words}
    lines = src.lines_of(docs, "text", "doc_id").select("doc_id", "line_no", T.normalize(F.col("line")).alias("n")).collect()
    rewrite = T.Rewriter(table)
    sizes = sorted({len(w) for w in words}, reverse=True)

    def slowly(text):
        out, i = [], 0
        while i < len(text):
            k = next((k for k in sizes if text[i : i + k] in table), 0)
            out.append(table[text[i : i + k]] if k else text[i])
            i += k or 1
        return "".join(out)

    assert all(rewrite(r["n"]) == slowly(r["n"]) for r in lines[:300])
    got = {(r["doc_id"], r["line_no"]): r["line"] for r in catalog.queries()["rewrite_longest"](spark, small).collect()}
    assert got == {(r["doc_id"], r["line_no"]): rewrite(r["n"]) for r in lines}


@pytest.mark.parametrize("make", [byte_pair_model, char_pair_model, ngram_model, sequence_model])
def test_spans_rebuild_the_text(spark, make):
    """Slices of all tokens are the text, but for spaces stripped at its ends."""
    model = make()
    texts = ["  the  and é ▁ x ", "", "plain and other", "ß\t日本 \U0001f642", "▁▁", "   ", None, "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", encode.token_spans(F.col("t"), model).alias("s"), encode.encode(F.col("t"), model).alias("e")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["s"] is None
            continue
        data, spans = r["t"].encode(), r["s"]
        assert [(x["piece"], x["id"]) for x in spans] == [(x["piece"], x["id"]) for x in r["e"]]
        assert all(a["end"] == b["start"] for a, b in zip(spans, spans[1:], strict=False)) and all(x["start"] <= x["end"] for x in spans)
        whole = b"".join(data[x["start"] : x["end"]] for x in spans).decode()
        assert whole.strip(" ▁") == (r["t"].strip(" ▁") if make is not sequence_model else r["t"].strip(" ▁"))


def test_only_tables_of_few_tasks_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    spark.range(1000).repartition(8).write.parquet(f"file://{tmp_path}/many")
    one, many, none = (spark.read.parquet(f"file://{tmp_path}/{x}") for x in ("one", "many", "one"))
    cores = spark.sparkContext.defaultParallelism
    assert src.spread(one).rdd.getNumPartitions() == cores and sorted(src.spread(one).collect()) == sorted(one.collect())
    assert src.spread(none.where("false")).rdd.getNumPartitions() == none.where("false").rdd.getNumPartitions()
    assert "Repartition" not in src.spread(many)._jdf.queryExecution().logical().toString()


def test_lines_that_are_no_json(spark, tmp_path):
    (tmp_path / "a").write_text('{"text": "one"}\n\n{"text": ""}\n{"title": "x"}\n{"text": "two"\n{"text": "three"}\n')
    with pytest.raises(Exception, match="not JSON"):
        src.read_articles(spark, f"{tmp_path}/a").collect()
    got = [tuple(r) for r in src.read_articles(spark, f"{tmp_path}/a", bad="keep").collect()]
    assert sorted(got, key=str) == sorted([("one", None), (None, '{"text": "two"'), ("three", None)], key=str)


def test_odd_lines_of_spaces_and_han(spark):
    """What the tables have none of: tabs, wide spaces, kana, rare Han, letters between."""
    given = ["  a  b ", "a\tb", " ", "", "▁a▁ ", "x   y z", "　w  "]
    got = spark.createDataFrame(list(enumerate(given)), "n int, line string").select("n", T.normalize(F.col("line")).alias("a"), T.normalize(F.col("line"), True).alias("b")).orderBy("n").collect()
    assert [r["a"] for r in got] == [re.sub(" +", "▁", x.lstrip(" ")).rstrip("▁") for x in given]
    assert [r["b"] for r in got] == [x.replace(" ", "▁") for x in given]
    lines = spark.createDataFrame(list(enumerate(["Tom▁他是英国人Bat", "他是英国人", "汉字とかな", "a▁汉b字", "々〇漢字１２", ""])), "n int, line string")
    words = {w.encode(): f for w, f in (("英国", 5.0), ("国人", 2.5), ("他", 1.0), ("是", 10.0), ("汉字", 3.0))}
    cut = [" ".join(r["tokens"]) for r in han.split_lines(lines, words).orderBy("n").collect()]
    assert cut == ["Tom ▁ 他 是 英国 人 Bat", "他 是 英国 人", "汉字 とかな", "a ▁ 汉 b 字", "々〇 漢 字 １２", ""]
    alone = [" ".join(r["tokens"]) for r in han.split_lines(lines, None).orderBy("n").collect()]
    assert alone == ["Tom ▁ 他 是 英 国 人 Bat", "他 是 英 国 人", "汉 字 とかな", "a ▁ 汉 b 字", "々〇 漢 字 １２", ""]


def test_offsets_and_repairs_of_odd_lines(spark):
    lines = spark.createDataFrame(list(enumerate(["a b", "  a  b", "é x ", "   ", ""])), "n int, line string")
    found = lines.select("n", T.normalize_with_offsets(F.col("line")).alias("f")).orderBy("n").collect()
    assert [(r["f"]["text"], r["f"]["offsets"]) for r in found] == [("a▁b", [0, 1, 1, 1, 2, 3]), ("a▁b", [2, 3, 3, 3, 5, 6]), ("é▁x", [0, 0, 2, 2, 2, 3, 4]), ("", []), ("", [])]
    given = [b"ab", b"\xc3\xa9", b"a\xffb", b"\xe4\xbd\xed", b"\xc0\x80x", b"\xed\xa0\x80", b""]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(given)], "n int, data binary")
    assert [r[0] for r in rows.orderBy("n").select(T.repair_utf8(F.col("data"))).collect()] == ["ab", "é", "a\ufffdb", "\ufffd" * 3, "\ufffd" * 2 + "x", "\ufffd" * 3, ""]


def test_han_words_of_long_lines_keep_pace(spark):
    """A line of many tokens: putting words back one by one took the square of them. Nulls and other tokens stay."""
    line = "他是▁abc-" * 20_000
    rows = spark.createDataFrame([(0, line), (1, None), (2, ""), (3, "ab▁他英国x")], "n int, line string")
    began = time.perf_counter()
    got = {r["n"]: r["tokens"] for r in han.split_lines(rows, {"英国".encode(): 5.0, "他".encode(): 1.0}).collect()}
    assert time.perf_counter() - began < 20
    assert got[0] == ["他", "是", "▁abc", "-"] * 20_000
    assert got[1] is None and got[2] == [] and got[3] == ["ab", "▁", "他", "英国", "x"]


@pytest.mark.parametrize("cut", [0, 1])
def test_han_apart_is_split_han(spark, cut):
    texts = ["他是▁英国a人b", "▁他,是", "", "ab▁12他他", None, "﨑𠀀𠀁x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(T.split_han(T.pretokenize(F.col("t"), cut)).alias("a"), T.pretokenize(F.col("t"), cut, han_apart=True).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_char_classes_cover_all_code_points(spark, small):
    rows = catalog.char_classes(spark, small).collect()
    assert sum(r["n"] for r in rows) == 0x10FFFF - 2048
    points = spark.read.parquet(f"{small}/documents.parquet").selectExpr("(doc_id * 7919 + n_chars * 104729) % 1114111 + 1 as id").where("id not between 55296 and 57343")
    assert sum(r["docs"] for r in rows) == points.count()
    assert sum(r["doc_ids"] for r in rows) == points.selectExpr("sum(id)").first()[0]
