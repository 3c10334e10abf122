"""Corpus preparation: headings, white space, sentences, word lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphmill.functions.text import map_longest


def strip_headings(text: Column) -> Column:
    """Without lines of ``#`` marks and a title. White space after the marks may span lines, so a bare ``#`` takes the next line too."""
    return F.regexp_replace(text, r"(?mdU)^#+\s+.*$", "")


def clean(text: Column) -> Column:
    """No headings, each run of white space one space, none at the ends."""
    one = F.regexp_replace(strip_headings(text), r"(?U)\s+", " ")
    return F.regexp_replace(one, r"^ +| +\z", "")


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with cleaned texts; those that become empty are left out."""
    return docs.withColumn(text_col, clean(F.col(text_col))).where(F.col(text_col) != "")


def map_phrases(text: Column, table: Mapping[str, str] | DataFrame) -> Column:
    """Longest-match phrase conversion, such as between scripts, by a table that the user supplies."""
    return map_longest(text, table)


def sentences(text: Column) -> Column:
    """Sentences: cut after wide end marks, and after ``.!?`` before white space or the end; trimmed, none empty."""
    parts = F.split(text, "(?U)(?<=[。！？])|(?<=[.!?])(?=\\s|\\z)")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")), lambda s: s != "")


def ascii_words(counts: DataFrame) -> DataFrame:
    """Rows whose word has two or more letters, all of them ASCII."""
    return counts.where(F.col("word").rlike(r"^[A-Za-z]{2,}\z"))
