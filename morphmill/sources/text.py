"""Line, JSON, dictionary, model and frequency sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphmill.functions.text import escape, escape_array
from morphmill.model import Model


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line): lines end with ``\\n`` alone. A missing path is an error."""
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt to all cores if most of them would get no row of it.

    A file of one row group is one task. How many tasks get rows is counted
    without reading a column; with enough of them nothing is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    filled = table.select(F.spark_partition_id().alias("task")).distinct().count()
    return table.repartition(cores) if 0 < filled <= cores // 2 else table


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(number, line) of the lines that aren't empty, from 0 in the order of paths, files and lines, without a sort.

    A split's lines come in order. One pass counts them by split, a running sum
    over the table of splits says where each begins, and the second pass adds
    that to a line's place in its split. Files of a folder are in the order of
    their names.
    """
    parts = []
    for k, path in enumerate(paths):
        own = spark.read.option("lineSep", "\n").text(path)
        where = [F.lit(k).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        parts.append(own.select(F.col("value").alias("line"), *where).where("line <> ''"))
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.union(more)
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    split = ["path", "file", "block"]
    counts = lines.groupBy(*split).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row for each split: within a file, and over the files' sums
    of_file = counts.groupBy("path", "file").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("path", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("inside", inside).join(of_file.select("path", "file", before.alias("before")), ["path", "file"])
    starts = starts.select(*split, (F.col("inside") + F.col("before") - F.col("first")).alias("start"))
    return lines.join(starts, split).select((F.col("at") + F.col("start")).alias("number"), "line")


def lines_of(table: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """Keys, line_no and line of each ``\\n``-separated line of a text column. A null text has no lines."""
    return table.select(*keys, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def first_lines(lines: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n lines that aren't empty, in the order of keys; n = 0 takes all."""
    some = lines.where("line <> ''")
    return some.orderBy(*order).limit(n) if n else some


def read_articles(spark: SparkSession, paths: str | list[str], bad: str = "fail") -> DataFrame:
    """Texts of JSON lines; blank lines and missing or empty texts are left out.

    A line that isn't JSON is an error when it is read; with ``bad="keep"`` it is
    a row with a null text and the line as ``bad_line``.
    """
    rows = spark.read.text(paths).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    if bad == "keep":
        found = rows.select(F.get_json_object("value", "$.text").alias("text"), F.when(parsed.isNull(), F.col("value")).alias("bad_line"))
        return found.where("bad_line is not null or (text is not null and text <> '')").withColumn("text", F.when(F.col("bad_line").isNull(), F.col("text")))
    text = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.left("value", F.lit(200)))).cast("string")).otherwise(F.get_json_object("value", "$.text"))
    return rows.select(text.alias("text")).where("text is not null and text <> ''")


def parse_dictionary(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(word, freq) of ``word\\tfreq`` lines. Bad lines and frequencies of 0 or less are left out; the first of a word counts."""
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    word = F.expr("substring_index(line, '\t', 1)")
    rest = F.expr("substring(line, locate('\t', line) + 1)")
    rows = lines.where(F.instr("line", "\t") > 1).select(order, word.alias("word"), F.regexp_extract(rest, number, 1).alias("n"))
    rows = rows.where("n <> ''").select(order, "word", F.col("n").cast("double").alias("freq")).where("freq > 0")
    first = F.row_number().over(Window.partitionBy("word").orderBy(order))
    return rows.withColumn("nth", first).where("nth = 1").select("word", "freq")


def read_model(spark: SparkSession, path: str) -> Model:
    """A model's text file, from any of Spark's stores; a missing path is an error."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return Model.from_text(text)


def write_model(spark: SparkSession, model: Model, prefix: str) -> str:
    """Write ``<prefix>.model`` as text and the vocabulary in full precision beside it; the text's path."""
    path = f"{prefix}.model"
    rows = spark.createDataFrame([(model.to_text().removesuffix("\n"),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)
    model.vocabulary(spark).coalesce(1).write.mode("overwrite").parquet(f"{prefix}.vocabulary")
    return path


def frequency_lines(counts: DataFrame) -> DataFrame:
    """``word\\tfreq`` lines; words as they are."""
    return counts.select(F.concat_ws("\t", "word", F.col("freq").cast("string")).alias("value"))


def token_line(tokens: Column, escaped: bool = False) -> Column:
    """Tokens joined by a space."""
    return F.array_join(F.transform(tokens, escape) if escaped else tokens, " ")


def piece_lines(rows: DataFrame, *keys: str, pieces: str = "pieces") -> DataFrame:
    """keys and ``value``: each row's pieces, of any bytes, escaped and joined by a space."""
    return rows.select(*keys, escape_array(F.col(pieces)).alias("value"))


def encoded_lines(encoded: DataFrame, *keys: str) -> DataFrame:
    """``piece\\tid`` lines of each row of ``encoded`` (keys, pieces, ids), and an empty line after each."""
    pairs = F.transform(F.arrays_zip("pieces", "ids"), lambda x: F.concat_ws("\t", x["pieces"].cast("string"), x["ids"].cast("string")))
    return encoded.select(*keys, F.posexplode(F.concat(pairs, F.array(F.lit("")))).alias("n", "value"))
