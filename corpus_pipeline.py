"""Documents to a mixed, encoded training set: five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

A null text is an empty one and fails the quality rules, as does one without
words; a null source is a source of its own. Ids are unique; rows without id stay
apart from one another. An empty table gives an empty result. Whatever columns
the documents have more go through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from morphmill.llm._shared import delete, keep, shared_dir, written
from morphmill.llm.bpe import encode_and_decode
from morphmill.llm.exact_dedup import copies_removed
from morphmill.llm.mixing import mix_documents, repeated
from morphmill.llm.ngram_join import near_copies_removed
from morphmill.llm.quality_rules import kept_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their hosts' verdicts keep."""
    return kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return copies_removed(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more."""
    return near_copies_removed(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return repeated(docs, mix_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text of the mix, and the digests of ids and of the text they decode to."""
    return encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near copies", near), ("mixture", mixture), ("tokens", tokens)]

#: The near-copy, flow and BPE stages are not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir; each stage's result is written to the shared folder and read again.

    A stage's tables go when its result is written, and that when the next one's is.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = shared_dir(spark, f"stage{k}")
        with written(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    keep(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
