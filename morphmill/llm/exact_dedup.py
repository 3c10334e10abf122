"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Each text is cut into blocks of a fixed number of bytes. Equal blocks get equal
integer names, by sorting; then neighbouring names are named as pairs, level by
level, until each text has one name. Two texts of one length are equal if and
only if their last names are: names are ranks of whole values, not hashes.

Sorting is spread over buckets, as many as the bytes of the texts ask for: a
name is the bucket of a value's hash, followed by the value's dense rank in that
bucket, so there is no global sort.
Blocks that a large part of the rows hold are found in a sample and named from
a table of at most 1000 rows, so their rows need not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, join_groups, spare_name

#: Buckets of the smallest table, and bytes of text that one more is made for.
LEAST_BUCKETS, BUCKET_BYTES = 64, 8 << 20
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Only texts with other characters take the slower way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _SMALL))


def _named(rows: DataFrame, value: list[str], buckets: int) -> DataFrame:
    """The distinct values of ``value`` with ``_bucket`` and ``_rank``, their names at this level.

    A value that very many rows hold is reduced to one row per map task before
    the shuffle; the names come back by an equi-join, whose large partitions
    Spark can split.
    """
    bucket = F.pmod(F.xxhash64(*value), F.lit(buckets)).cast("long")
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*value)).cast("long")
    return rows.select(*value).distinct().withColumn("_bucket", bucket).withColumn("_rank", rank)


def _frequent(cut: DataFrame, buckets: int) -> DataFrame | None:
    """Names of blocks that are frequent in a sample of rows: 1000 at most, as each has over a thousandth.

    Which blocks these are changes where a block is named, not which blocks are equal.
    """
    counts = cut.where("pmod(xxhash64(row), 32) = 0").groupBy("block").count()
    n = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > max(16, n / 1000)).select("block")
    blocks = sorted(bytes(r[0]) for r in hot.collect())
    if not blocks:
        return None
    return cut.sparkSession.createDataFrame([(b, buckets, i) for i, b in enumerate(blocks)], "block binary, hot_bucket long, hot_name long")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048, buckets: int | None = None) -> DataFrame:
    """One row per row of docs: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts (A-Z lower-cased, a null is an empty text) the row with the
    largest id stays; a null id is smaller than any other. Of rows that repeat
    both id and text, one stays. Other columns of docs are neither read nor
    returned. An empty table gives an empty result. ``buckets``: by default one
    per ``BUCKET_BYTES`` of text.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        if buckets is None:
            size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
            buckets = LEAST_BUCKETS + size // BUCKET_BYTES
        norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
        base = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("t")).select("id", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), F.col("t").cast("binary").alias("t"))
        base = base.withColumn("row", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("t").cast("long"))
        last = F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / block_bytes)).cast("int")
        block = F.expr(f"transform(sequence(0, last), i -> substring(t, i * {block_bytes} + 1, {block_bytes}))")
        cut = base.withColumn("last", last).select("row", "id", "sha", "bytes", "last", F.posexplode(block).alias("pos", "block"))
        head = F.when(F.col("pos") == 0, F.struct("id", "sha", "bytes"))
        cut = cut.select("row", "pos", "last", "block", head.alias("head"))
        hot = _frequent(cut, buckets)
        if hot is None:
            cut = cut.withColumn("hot_bucket", F.lit(None).cast("long")).withColumn("hot_name", F.lit(None).cast("long"))
        else:
            cut = cut.join(F.broadcast(hot), "block", "left")
        cold = F.col("hot_name").isNull()
        cut = cut.withColumn("bucket", F.pmod(F.when(cold, F.xxhash64("block")).otherwise(F.xxhash64("row")), F.lit(buckets)).cast("long"))
        cut = cut.withColumn("block", F.when(cold, F.col("block")))
        ranked = Window.partitionBy("bucket").orderBy("block")
        name = F.coalesce("hot_name", F.dense_rank().over(ranked).cast("long"))
        level = cut.select("row", "pos", "last", F.coalesce("hot_bucket", "bucket").alias("b"), name.alias("name"), "head")
        level = scratch.save(level, "names")
        done = level.where("last = 0").select("row", F.col("head.id").alias("id"), F.col("head.sha").alias("sha"), F.col("head.bytes").alias("bytes"), "b", "name")
        rest, ended = level.where("last > 0"), [done]
        while rest.limit(1).count():
            half = F.floor(F.col("pos") / 2).cast("int")
            left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
            pairs = rest.groupBy("row", half.alias("pos"), F.floor(F.col("last") / 2).cast("int").alias("last")).agg(
                F.max(F.when(left, F.col("b"))).alias("lb"), F.max(F.when(left, F.col("name"))).alias("ln"),
                F.coalesce(F.max(F.when(right, F.col("b"))), F.lit(-1)).alias("rb"), F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("rn"),
                F.max("head").alias("head"),
            )
            value = ["lb", "ln", "rb", "rn"]
            pairs = scratch.save(pairs, "pairs")
            named = pairs.join(_named(pairs, value, buckets), value)
            level = scratch.save(named.select("row", "pos", "last", F.col("_bucket").alias("b"), F.col("_rank").alias("name"), "head"), "names")
            ended.append(level.where("last = 0").select("row", F.col("head.id").alias("id"), F.col("head.sha").alias("sha"), F.col("head.bytes").alias("bytes"), "b", "name"))
            rest = level.where("last > 0")
        named = ended[0]
        for more in ended[1:]:
            named = named.unionByName(more)
        named = scratch.save(named, "identities", keep=True)
        same = ["bytes", "b", "name"]
        keep = F.max(F.struct(F.col("id"), F.col("row"))).alias("keep")
        groups = scratch.save(named.groupBy(*same).agg(keep, F.count("*").alias("group_size")), "groups", keep=True)
        out = join_groups(named, groups, same, "group_size")
    return out.select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that ``exact_copies`` keeps, columns as they are; ids are unique, but of rows that repeat an id one stays for each text."""
    own, sha, of = (spare_name(docs, c) for c in ("_id", "_sha", "_of"))
    copies = exact_copies(docs, id_col, text_col, **how)
    with Scratch(docs.sparkSession) as scratch:
        kept = scratch.save(copies.where("kept").select(F.col(id_col).alias(own), F.col("text_sha256").alias(of)), "kept", keep=True)
        repeats = kept.groupBy(own).count().where("count > 1").limit(1).count() or docs.groupBy(id_col).count().where("count > 1").limit(1).count()
        if not repeats:
            # an id is a row, and its name has said whether it stays
            return docs.join(kept.select(own), docs[id_col].eqNullSafe(F.col(own)), "left_semi")
        marked = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
        same = marked[id_col].eqNullSafe(F.col(own)) & (F.col(sha) == F.col(of))
        # rows that repeat id and text stand next to each other after the join, and one of them stays
        return marked.join(kept, same, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
