"""Audit of how filters over documents interact, as a pipeline of relations.

Words are exploded and aggregated by (document, word), then by document, for
totals and distinct words. The other flags are joined to that. A document's five
flags are a set of failed filters; for each of the 32 sets of filters one
conditional count per part says how many documents fail none of them, and every
order of the filters, step by step, is a difference of two of these counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, join_groups

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
RESULT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step from 1, set of the filters before, the step's own filter as a set) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), k + 1, before, 1 << f))
            before |= 1 << f
    return out


def word_totals(rows: DataFrame) -> DataFrame:
    """(row, words, different) of rows (row, text) that have a word.

    Rows are dealt once, by ``row``, which serves both aggregates: no word is shuffled.
    """
    words = rows.repartition("row").select("row", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    of_row = words.groupBy("row", "word").agg(F.count("*").alias("n"))
    return of_row.groupBy("row").agg(F.sum("n").alias("words"), F.count("*").alias("different"))


def failed_filters(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per row of docs: ``part``, ``failed`` (the set of filters it fails, A is bit 0), ``good``, ``toxic``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.withColumn("row", F.monotonically_increasing_id())
    upper = F.regexp_count("text", F.lit("[A-Z]"))
    own = own.withColumn("c", 100 * upper.cast("long") > 2 * F.char_length("text")).withColumn("d", F.col("text").rlike(SYMBOLS))
    # written once: the number of a row is the same wherever it is read
    own = scratch.save(own.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), "rows")
    groups = own.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("held")).where("held > 1 and first is not null")
    groups = scratch.save(groups, "texts")
    later = join_groups(own.select("row", "id", "digest"), groups, ["digest"], "held").where("id > first").select("row", F.lit(True).alias("e"))
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    judged = own.select("row", "id").join(judged, "id").select("row", "good", "toxic")
    wide = own.select("row", "part", "c", "d").join(word_totals(own.select("row", "text")), "row", "left").join(later, "row", "left").join(judged, "row", "left")
    words, different = F.coalesce("words", F.lit(0)), F.coalesce("different", F.lit(0))
    flags = [words < 200, 100 * different < 50 * words, F.col("c"), F.col("d"), F.coalesce("e", F.lit(False))]
    failed = sum((F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags)), F.lit(0))
    return wide.select("part", failed.alias("failed"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def interactions(tally: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n), n documents, to RESULT: 32 conditional counts of each kind, then all steps of all orders."""
    kinds = {"kept": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [
        F.sum(F.when((F.col("failed").bitwiseAND(s) == 0) & kind, F.col("n")).otherwise(0)).alias(f"{name}_{s}")
        for name, kind in kinds.items()
        for s in range(ALL + 1)
    ]
    wide = tally.groupBy("part").agg(*counts)

    def without(kind: str, s: int) -> Column:
        return F.col(f"{kind}_{s}")

    def shapley(f: int) -> Column:
        """What a filter removes over all orders: by the set before it, times the orders that start with that set."""
        before = [s for s in range(ALL + 1) if not s & f]
        of = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return sum(((without("kept", s) - without("kept", s | f)) * of(s) for s in before), F.lit(0))

    arrays = [F.array(*(without(kind, s) for s in range(ALL + 1))).alias(kind) for kind in kinds]
    shares = F.array(*(shapley(1 << i) for i in range(len(FILTERS)))).alias("shares")
    listed = ", ".join(f"struct('{o}' as filter_order, {k} as step, {b} as before, {f} as own)" for o, k, b, f in steps())
    long = wide.select("part", *arrays, shares).select("*", F.expr(f"inline(array({listed}))"))
    return long.selectExpr(
        "part", "filter_order", "step", "kept[before | own] as kept", "kept[before] - kept[before | own] as removed",
        "(kept[0] - kept[own]) - (kept[before] - kept[before | own]) as redundant", f"kept[{ALL} - own] - kept[{ALL}] as unique_fails",
        "good[before] - good[before | own] as good_lost", "toxic[before] - toxic[before | own] as toxic_lost",
        "shares[cast(log2(own) as int)] as shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; RESULT are its columns.

    A: under 200 words. B: under half of the words are distinct. C: over 2 % of
    the characters are A-Z. D: any of ``#$%&*|``. E: the text of a smaller id.
    Every row of docs is a document, those that repeat an id or a text too. A
    null text is empty, a null part is ''. A row without id is no copy and has no
    label, and none is a copy of it. A document has a label if any row of labels
    says so; nulls say nothing. Other columns are not read. An empty table gives
    an empty result. Equal texts are found by their SHA-256.
    """
    with Scratch(docs.sparkSession) as scratch:
        failed = failed_filters(docs, labels, scratch, id_col, text_col, part_col)
        # 128 rows a part at most: a part that most documents are of is no more work than another
        tally = scratch.save(failed.groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n")), "tally", keep=True)
    return interactions(tally)
