"""Streams of lines: the stateless text functions as they are, and running word counts.

An extension: nothing in the batch operators depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphmill.functions.text import normalize, pretokenize
from morphmill.operators.stats import word_counts, words_of


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the text files that come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "line")


def stream_tokens(lines: DataFrame, cut: int = 0) -> DataFrame:
    """Lines with their tokens; stateless."""
    return lines.withColumn("tokens", pretokenize(normalize(F.col("line")), cut))


def stream_word_counts(lines: DataFrame, cut: int = 0) -> DataFrame:
    """Running (word, freq), for the output modes complete and update; the state has a row per distinct word."""
    return word_counts(words_of(lines, cut))
