"""Every operator over odd tables: nulls, empty and long texts, repeats, clashing columns, no rows."""

from __future__ import annotations

import public_tokenizers
import pytest

from morphmill.llm import bpe, exact_dedup, line_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, substring_dedup

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "A very long text. " * 20_000
PLAIN = " ".join(f"word{i} and more" for i in range(60))
ROWS = [
    (1, PLAIN, "en", "web"), (2, PLAIN, "en", "web"), (2, PLAIN, "en", "web"), (3, None, None, None), (4, "", "en", "web"),
    (None, PLAIN, "de", None), (None, None, None, None), (5, LONG, "fr", "x"), (6, " \n\t ", "fr", "x"), (7, "one", "en", "x"), (8, "\n\n", None, "x"), (9, "\x00é\U0001f642 ｘ", "en", "x"),
]
EXTRA = "id row t n h1 h2 key keys bits block group comp component rep a b size pattern order part words sha last pos head hot_name bucket name unit start end first latest spans units host counts kept p x y evidence ids _gone _kept _id _of _sha _mixed _copies _copy _spans _text base_failed wanted chunks".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def labels(spark):
    return spark.createDataFrame([(1, 1), (7, 0), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")


OPERATORS = {
    "mix": lambda s, d: mixing.mix_documents(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "personal data": lambda s, d: pii.find_personal_data(d, train_texts=20),
    "classifier": lambda s, d: quality_classifier.classify(d, labels(s)),
    "n-gram join": lambda s, d: ngram_join.ngram_join(d),
    "substrings": lambda s, d: substring_dedup.repeated_spans(d),
    "exact": lambda s, d: exact_dedup.exact_copies(d),
    "bpe": lambda s, d: bpe.digests(d, VOCABULARY),
    "encode": lambda s, d: bpe.encode(d, VOCABULARY),
    "lines": lambda s, d: line_dedup.repeated_chunks(d),
}
STAGES = {
    "rules": lambda d: quality_rules.kept_documents(d),
    "exact": lambda d: exact_dedup.copies_removed(d),
    "near": lambda d: ngram_join.near_copies_removed(d),
    "mixture": lambda d: mixing.repeated(d, mixing.mix_documents(d)),
    "substrings": lambda d: substring_dedup.without_spans(d, substring_dedup.repeated_spans(d)),
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, *EXTRA) for r in ROWS], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_per_row(spark, odd, name):
    assert sorted(OPERATORS[name](spark, odd).toPandas()["doc_id"].fillna(-1)) == sorted(r[0] or -1 for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.where("false")).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, odd, name):
    once = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = STAGES[name](once)
    assert out.columns == odd.columns
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS}
    assert all(r["row"] == "row" and r["_id"] == "_id" for r in rows)
    assert STAGES[name](odd.where("false")).collect() == []


def test_stages_over_nulls_and_repeats(spark, odd):
    kept = [r["doc_id"] for r in exact_dedup.copies_removed(odd).collect()]
    assert sorted(kept) == [2, 4, 5, 6, 7, 8, 9]
    near = [r["doc_id"] for r in ngram_join.near_copies_removed(odd).collect()]
    assert near.count(1) == 1 and 2 not in near and near.count(None) == 2


def test_exact_copies_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_copies(odd, block_bytes=7).collect()}
    assert {(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, False), (None, 2, 4, False), (3, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False)} <= got


def test_block_names_do_not_depend_on_block_size(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = sorted(exact_dedup.exact_copies(docs, block_bytes=64, buckets=3).collect())
    assert some == sorted(exact_dedup.exact_copies(docs).collect())
