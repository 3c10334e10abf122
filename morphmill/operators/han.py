"""Han text: cutting runs with a dictionary, by the most probable words."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphmill.functions.batches import lengths
from morphmill.functions.text import HAN_RANGES, pretokenize
from morphmill.operators.segment import Unigram

#: Entries that a dictionary sent to the executors may have.
MOST_WORDS = 2_000_000


def dictionary_of(words: DataFrame) -> dict[bytes, float]:
    """A checked (word, freq) table as the dictionary that is sent to executors."""
    if words.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return {r["word"].encode(): r["freq"] for r in words.collect()}


def fingerprint(words: DataFrame) -> str:
    """A dictionary's identity, to be kept with a model that was trained with it."""
    row = words.agg(F.count("*").alias("n"), F.sum(F.xxhash64("word", "freq").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def _cut_runs(tokens: Column, dictionary: dict[bytes, float]) -> Column:
    """Tokens with the Han ones cut into words. A batch cuts each different token once."""
    total = sum(dictionary.values())
    held = SparkSession.getActiveSession().sparkContext.broadcast(dictionary)
    fallback = math.log(1 / total) if total > 0 else -10.0
    han = re.compile("[" + "".join("-".join(chr(int(end, 16)) for end in r.split("-")) for r in HAN_RANGES.split()) + "]")

    built: list[Unigram] = []

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        if not built:
            built.append(Unigram(held.value, fallback))
        coded = rows.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        cuts = pa.array([[w.decode() for w in built[0].cut(t.encode())] if han.match(t) else [t] for t in names], pa.list_(pa.string()))
        taken = cuts.take(coded.indices)
        return pa.ListArray.from_arrays(taken.offsets.take(pa.array(lengths(rows)[1])), taken.flatten())

    return F.when(tokens.isNotNull(), run(tokens))


def split_lines(lines: DataFrame, dictionary: dict[bytes, float] | None, cut: int = 0, col: str = "line") -> DataFrame:
    """lines with ``tokens`` of the normalised column, Han runs cut."""
    if dictionary is None:
        return lines.withColumn("tokens", pretokenize(F.col(col), cut, han_apart=True))
    return lines.withColumn("tokens", _cut_runs(pretokenize(F.col(col), cut), dictionary))
