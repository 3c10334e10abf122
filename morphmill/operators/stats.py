"""Statistics over lines, words, characters, pairs and n-grams: plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphmill.functions.text import normalize, pretokenize
from morphmill.operators.storage import lasting


def words_of(lines: DataFrame, cut: int = 0, reconstruct: bool = False, han: str | None = None) -> DataFrame:
    """One row per token of each line. han = "no" cuts Han runs into characters."""
    return lines.select(F.explode(pretokenize(normalize(F.col("line"), reconstruct), cut, han_apart=han == "no")).alias("word"))


def word_counts(words: DataFrame, max_bytes: int = 0, min_count: int = 1) -> DataFrame:
    """(word, freq); long words out before, rare ones after the aggregate."""
    if max_bytes:
        words = words.where(F.octet_length("word") <= max_bytes)
    counts = words.groupBy("word").agg(F.count("*").alias("freq"))
    return counts.where(F.col("freq") >= min_count) if min_count > 1 else counts


def by_frequency(counts: DataFrame, *more: str) -> DataFrame:
    """Frequency descending, then word: a total order."""
    return counts.orderBy(F.desc("freq"), *(more or ("word",)))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def char_counts(counts: DataFrame) -> DataFrame:
    """(char, cnt), weighted by the words' frequencies."""
    return counts.select(F.explode(characters(F.col("word"))).alias("char"), "freq").groupBy("char").agg(F.sum("freq").alias("cnt"))


def covered_chars(chars: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """Characters in order of count, while the share of those before is below ``coverage``.

    The alphabet is small: its running sum is the one global window here.
    """
    order = Window.orderBy(F.desc("cnt"), "char")
    before = F.coalesce(F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = chars.agg(F.sum("cnt").alias("total"))
    return chars.withColumn("before", before).crossJoin(F.broadcast(total)).where(F.col("before") / F.col("total") < coverage).select("char", "cnt")


def with_unknown(counts: DataFrame, kept: DataFrame, unknown: str = "▅") -> DataFrame:
    """Words with the characters not in ``kept`` replaced; equal results are not merged.

    The set of characters is one row: a class of a regular expression, by code points.
    """
    point = F.conv(F.hex(F.encode("char", "UTF-32")), 16, 16)
    known = kept.agg(F.concat(F.lit("[^"), F.array_join(F.collect_set(F.concat(F.lit("\\x{"), point, F.lit("}"))), ""), F.lit("]")).alias("others"))
    swapped = F.regexp_replace("word", F.col("others"), F.lit(unknown))
    none = F.regexp_replace("word", "(?s).", unknown)
    return counts.crossJoin(F.broadcast(known)).select(F.when(F.col("others") == "[^]", none).otherwise(swapped).alias("word"), "freq")


def bytes_of(word: Column) -> Column:
    """A word's bytes as two hexadecimal digits each."""
    return F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0))


def pair_counts(counts: DataFrame, symbols: Column) -> DataFrame:
    """(l, r, cnt) of neighbouring symbols, overlaps counted, weighted by freq."""
    rows = counts.select(symbols.alias("t"), "freq").where("size(t) > 1")
    pairs = rows.select(F.explode(F.expr("transform(sequence(0, size(t) - 2), i -> struct(t[i] as l, t[i + 1] as r))")).alias("p"), "freq")
    return pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").alias("cnt"))


def best_pairs(pairs: DataFrame, n: int = 1) -> DataFrame:
    """The n best pairs: count descending, then the larger symbol, l and r ascending."""
    return pairs.orderBy(F.desc("cnt"), F.greatest("l", "r"), "l", "r").limit(n)


def byte_ngrams(counts: DataFrame, most: int = 6) -> DataFrame:
    """(n, gram in hexadecimal, cnt) of the byte n-grams of words, n = 1..most; windows stay in a word."""
    rows = counts.select(F.hex(F.encode("word", "UTF-8")).alias("h"), "freq").where("h <> ''")
    grams = f"flatten(transform(sequence(1, length(h) div 2), i -> transform(sequence(1, least({most}, length(h) div 2 - i + 1)), n -> substring(h, 2 * i - 1, 2 * n))))"
    counted = rows.select(F.explode(F.expr(grams)).alias("gram"), "freq").groupBy("gram").agg(F.sum("freq").alias("cnt"))
    return counted.select(F.expr("cast(length(gram) div 2 as int)").alias("n"), "gram", "cnt")


def byte_pair_counts(counts: DataFrame) -> DataFrame:
    """(l, r, cnt) of neighbouring bytes, in hexadecimal: pairs are cut out of the words' bytes as they are grouped."""
    rows = counts.select(F.hex(F.encode("word", "UTF-8")).alias("h"), "freq").where("length(h) > 2")
    pairs = rows.select(F.explode(F.expr("transform(sequence(1, length(h) div 2 - 1), i -> substring(h, 2 * i - 1, 4))")).alias("p"), "freq")
    return pairs.groupBy("p").agg(F.sum("freq").alias("cnt")).select(F.substring("p", 1, 2).alias("l"), F.substring("p", 3, 2).alias("r"), "cnt")


def ngram_logprobs(grams: DataFrame, min_count: int = 1) -> DataFrame:
    """(n, gram, cnt, logp): log of cnt over the prefix's cnt, for n = 1 over all bytes.

    Bytes that don't occur count once; longer n-grams below ``min_count`` are
    left out. The prefix comes by an equi-join on (n - 1, prefix). What is
    kept of ``grams`` is used several times, so it is written once.
    """
    spark = grams.sparkSession
    grams = lasting(grams.where(f"n = 1 or cnt >= {min_count}"), "grams")
    every = spark.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("gram"))
    ones = every.join(grams.where("n = 1"), "gram", "left").select(F.lit(1).alias("n"), "gram", F.coalesce("cnt", F.lit(1)).cast("long").alias("cnt"))
    total = ones.agg(F.sum("cnt").alias("total"))
    kept = ones.union(grams.where(f"n > 1 and cnt >= {min_count}").select("n", "gram", "cnt"))
    prefix = kept.select((F.col("n") + 1).alias("n"), F.col("gram").alias("prefix"), F.col("cnt").alias("prefix_cnt"))
    longer = kept.where("n > 1").withColumn("prefix", F.expr("substring(gram, 1, 2 * (n - 1))")).join(prefix, ["n", "prefix"])
    longer = longer.select("n", "gram", "cnt", (F.log("cnt") - F.log("prefix_cnt")).alias("logp"))
    return ones.crossJoin(F.broadcast(total)).select("n", "gram", "cnt", (F.log("cnt") - F.log("total")).alias("logp")).union(longer)
