"""Queries of the core operators over the standard tables; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphmill.functions import sql
from morphmill.functions import text as T
from morphmill.model import BYTE_PAIR, CHAR_PAIR, CONTROL, NGRAM, NORMAL, SEQUENCE, Model, NormalizerSpec, Piece, TrainSpec, byte_pieces, layout
from morphmill.operators import corpus, encode, han, stats, train
from morphmill.plans.examples import HAN_VOWELS, byte_pair_model, char_pair_model, ngram_model, sequence_model
from morphmill.plans.oracles import oracle_sql  # noqa: F401
from morphmill.operators.storage import lasting_folder
from morphmill.sources import models
from morphmill.sources import text as src


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return src.spread(table) if name == "documents" else table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.lines_of(_table(spark, sf_dir, "documents"), "text", "doc_id")


def _counts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return stats.word_counts(stats.words_of(_lines(spark, sf_dir)), **how)


# ---- queries --------------------------------------------------------------------------------------


def raw_count(spark, sf_dir):
    return stats.by_frequency(_counts(spark, sf_dir))


def raw_count_maxbytes(spark, sf_dir):
    return _counts(spark, sf_dir, max_bytes=12)


def _pretokenized(cut: int, reconstruct: bool = False):
    def query(spark, sf_dir):
        tokens = T.pretokenize(T.normalize(F.col("line"), reconstruct), cut)
        return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), src.token_line(tokens).alias("tokens"))

    return query


def normalize(spark, sf_dir):
    spaced = F.concat(F.lit("  "), F.regexp_replace("line", " ", "   "), F.lit("▁ "))
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.normalize(spaced).alias("line"))


def restore_spaces(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.restore_spaces(T.normalize(F.col("text"))).alias("text"))


def _spaced(line):
    """Lines with spaces at their ends, in runs, and with tabs and sentinels, which the tables don't have."""
    return F.concat(F.lit("  "), F.replace(F.replace(line, F.lit(" "), F.lit("   ")), F.lit(","), F.lit("\t ▁")), F.lit(" ▁ "))


def space_runs(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), _spaced(F.col("line")).alias("line"))
    return rows.select("doc_id", "line_no", T.normalize(F.col("line")).alias("merged"), T.normalize(F.col("line"), True).alias("kept"), src.token_line(T.pretokenize(T.normalize(F.col("line")))).alias("tokens"))


def word_min_count(spark, sf_dir):
    return _counts(spark, sf_dir, min_count=32)


def first_n_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("line_no", F.col("line_no").cast("long"))
    return src.first_lines(lines, 100, "doc_id", "line_no")


def char_freq(spark, sf_dir):
    return stats.char_counts(_counts(spark, sf_dir))


def char_coverage(spark, sf_dir):
    return stats.covered_chars(stats.char_counts(_counts(spark, sf_dir)))


def words_with_unk(spark, sf_dir):
    counts = _counts(spark, sf_dir, min_count=2)
    return stats.with_unknown(counts, stats.covered_chars(stats.char_counts(counts), 0.99))


def pair_counts(spark, sf_dir):
    return stats.byte_pair_counts(_counts(spark, sf_dir))


def best_pair(spark, sf_dir):
    return stats.best_pairs(pair_counts(spark, sf_dir))


def byte_ngrams(spark, sf_dir):
    return stats.byte_ngrams(_counts(spark, sf_dir))


def ngram_logprob(spark, sf_dir):
    probs = stats.ngram_logprobs(stats.byte_ngrams(_counts(spark, sf_dir)), 32)
    return probs.select("n", "gram", "cnt", F.round("logp", 9).alias("logp"))


def sentences(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(corpus.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n").cast("long"))


def clean_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("## title\n"), F.regexp_replace("text", "\\. ", ".\n# a b\n \t")).alias("text"))
    return corpus.clean_documents(docs)


def strip_headings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("#\nfirst\n"), F.col("text"), F.lit("\n### last")).alias("text"))
    return docs.select("doc_id", corpus.strip_headings(F.col("text")).alias("text"))


def ascii_words(spark, sf_dir):
    return corpus.ascii_words(_counts(spark, sf_dir))


def byte_piece_table(spark, sf_dir):
    """The bytes of all words, their pieces and back."""
    bytes_ = _counts(spark, sf_dir).select(F.explode(stats.bytes_of(F.col("word"))).alias("h"), "freq").groupBy("h").agg(F.sum("freq").alias("cnt"))
    pieces = bytes_.select(F.conv("h", 16, 10).cast("long").alias("byte"), "cnt").select("byte", T.byte_to_piece(F.col("byte")).alias("piece"), "cnt")
    return pieces.select("byte", "piece", T.piece_to_byte(F.col("piece")).cast("long").alias("back"), "cnt")


def _shown(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select("id", F.hex("piece").alias("piece"), (F.col("score") + 0.0).alias("score"), "type", F.hex("u").alias("u"), F.hex("v").alias("v"))


def vocab_layout(spark, sf_dir):
    """Special pieces, byte pieces, and the characters that cover documents."""
    chars = stats.covered_chars(stats.char_counts(_counts(spark, sf_dir))).orderBy(F.desc("cnt"), "char").collect()
    spec = TrainSpec(CHAR_PAIR, 259 + len(chars))
    own = layout(spec.meta() | {3 + i: p for i, p in enumerate(byte_pieces())}, [Piece(r["char"].encode(), -float(i)) for i, r in enumerate(chars)], spec.vocab_size)
    return Model(spec, NormalizerSpec(), own).vocabulary(spark).select("id", F.col("piece").cast("string").alias("piece"), "type")


def extra_tokens(spark, sf_dir):
    """A trained model with a padding token and one for each language of documents."""
    spec = _spec(BYTE_PAIR, 4, min_count=2)
    model = train.train_byte_pair(train.training_words(_lines(spark, sf_dir), spec), spec)
    langs = sorted(r[0] for r in _table(spark, sf_dir, "documents").select("lang").where("lang is not null").distinct().collect())
    more = model.with_control_tokens(["<pad>", *(f"<{x}>" for x in langs)])
    return more.vocabulary(spark).where(F.col("type") == CONTROL).select("id", F.col("piece").cast("string").alias("piece"), F.lit(more.spec.vocab_size).alias("vocab_size"), F.lit(more.spec.pad_id).alias("pad_id"))


def piece_to_id(spark, sf_dir):
    pieces = _counts(spark, sf_dir).select(F.encode("word", "UTF-8").alias("piece"), "freq")
    found = encode.piece_ids(pieces, byte_pair_model().vocabulary(spark), 0)
    return found.select(F.hex("piece").alias("piece"), "freq", "id")


def _encoded_hex(model: Model, text) -> object:
    return encode.token_line(text, model, encode.in_hex, "", fallen=True)


def _encoded(model: Callable[[], Model]):
    def query(spark, sf_dir):
        return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), _encoded_hex(model(), F.col("line")).alias("pieces"))

    return query


def _decoded(make: Callable[[], Model]):
    def query(spark, sf_dir):
        model = make()
        rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", encode.encode_ids(F.col("text"), model).alias("ids"))
        return encode.decode(rows, model, "conv_id", "turn")

    return query


def char_classes(spark, sf_dir):
    """All code points and their classes; beside them how many documents fall on each by id and size, and these points' sum."""
    point = F.expr("(doc_id * 7919 + n_chars * 104729) % 1114111 + 1")
    char = F.when(F.col("id") < 65536, F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")).otherwise(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    hits = _table(spark, sf_dir, "documents").select(point.alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("hits"))
    points = spark.range(1, 1114112).where("id not between 55296 and 57343").join(hits, "id", "left").select("id", F.coalesce("hits", F.lit(0)).alias("hits"), char.alias("c"))
    classes = [f(F.col("c")).alias(n) for n, f in (("han", T.is_han), ("word", T.is_word_char), ("digit", T.is_digit), ("punctuation", T.is_punctuation))]
    found = points.select("id", "hits", F.expr("id div 256").alias("block"), *classes).groupBy("block", "han", "word", "digit", "punctuation")
    return found.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("hits").alias("docs"), F.sum(F.col("id") * F.col("hits")).alias("doc_ids"))


def unescape(spark, sf_dir):
    return escaped(spark, sf_dir).select("doc_id", T.unescape(F.col("text")).cast("string").alias("text"))


def repair_utf8(spark, sf_dir):
    """Lines with bytes between and after them that are no UTF-8."""
    data = F.concat(F.encode("line", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.substring("line", 1, 5), "UTF-8"), F.unhex(F.lit("E4BD")))
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.repair_utf8(data).alias("text"))


def offset_map(spark, sf_dir):
    spaced = F.concat(F.lit("  "), F.replace(F.col("line"), F.lit(" "), F.lit("   ")))
    found = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.normalize_with_offsets(spaced).alias("f"))
    return found.select("doc_id", "line_no", "f.text", F.array_join(F.col("f.offsets").cast("array<string>"), ",").alias("offsets"))


def escaped(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.escape(F.concat("text", F.lit("\\\t\r"))).alias("text"))


def han_split(spark, sf_dir):
    """Lines whose vowels are Han characters, which the tables don't have."""
    lines = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.translate(T.normalize(F.col("line")), "aeiou", HAN_VOWELS).alias("line"))
    return han.split_lines(lines, None).select("doc_id", "line_no", F.array_join("tokens", " ").alias("tokens"))


def han_dictionary(spark, sf_dir):
    """Dictionary lines of documents: a third of them without a tab, a number or a frequency above 0."""
    line = F.expr("CASE doc_id % 6 WHEN 0 THEN concat(substring(text, 1, 3), n_chars) WHEN 1 THEN concat(substring(text, 1, 3), '\t-', n_chars) WHEN 2 THEN concat(substring(text, 1, 3), '\t', n_chars, '.5x') ELSE concat(substring(text, 1, 3), '\t', n_chars) END")
    return src.parse_dictionary(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), line.alias("line")))


def han_dictionary_split(spark, sf_dir):
    """Han runs of one or two characters by a dictionary; a mark is put behind each second one."""
    words = {w.encode(): f for w, f in (("他", 1.0), ("是", 10.0), ("英国", 5.0), ("国人", 2.5), ("人是", 4.0))}
    runs = F.regexp_replace(F.translate(T.normalize(F.col("line")), "aeiou", HAN_VOWELS), f"([{HAN_VOWELS}]{{2}})", "$1-")
    lines = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), runs.alias("line"))
    return han.split_lines(lines, words).select("doc_id", "line_no", F.array_join("tokens", " ").alias("tokens"))


def unicode_normalize(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.unicode_normalize(F.col("text"), "NFKC_CF").alias("text"))


def frequency_lines(spark, sf_dir):
    return src.frequency_lines(_counts(spark, sf_dir, min_count=2))


def model_round_trip(spark, sf_dir):
    spec = _spec(BYTE_PAIR, 24, min_count=2)
    model = train.train_byte_pair(train.training_words(_lines(spark, sf_dir), spec), spec)
    return _shown(Model.from_text(model.to_text()).vocabulary(spark))


def _spec(method: str, merges: int, **how) -> TrainSpec:
    return TrainSpec(method, train.stored_size(method, 256 + merges if method in (BYTE_PAIR, SEQUENCE) else merges), **how)


def train_byte_pair(spark, sf_dir):
    spec = _spec(BYTE_PAIR, 24, min_count=2)
    return _shown(train.train_byte_pair(train.training_words(_lines(spark, sf_dir), spec), spec).vocabulary(spark))


def train_char_pair(spark, sf_dir):
    """All of the 8,000 entries that a model has unless told otherwise, the characters that must have a piece among them."""
    spec = _spec(CHAR_PAIR, TrainSpec().vocab_size, min_count=2)
    return _shown(train.train_char_pair(train.training_words(_lines(spark, sf_dir), spec), spec).vocabulary(spark))


def train_ngram(spark, sf_dir):
    return _shown(train.train_ngram(_counts(spark, sf_dir), _spec(NGRAM, 500, min_count=32)).vocabulary(spark))


def train_sequence(spark, sf_dir):
    return _shown(train.train_sequence(src.lines_of(_table(spark, sf_dir, "benchmark"), "text", "item_id"), _spec(SEQUENCE, 24), "item_id", "line_no").vocabulary(spark))


def numbered_lines(spark, sf_dir):
    """The lines of documents, written to several files in the order of ids, read back with their numbers."""
    path = lasting_folder(spark, "lines")
    lines = _lines(spark, sf_dir).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id", "line_no")
    lines.select("line").write.option("lineSep", "\n").text(path)
    return src.numbered_lines(spark, [path])


def model_source(spark, sf_dir):
    """A model trained from documents, through a file and its data source."""
    spec = _spec(BYTE_PAIR, 24, min_count=2)
    model = train.train_byte_pair(train.training_words(_lines(spark, sf_dir), spec), spec)
    path = f"{lasting_folder(spark, 'models')}/words.model"
    models.save_model(spark, model, path)
    return _shown(models.load_vocabulary(spark, path))


def tokenize_lines(spark, sf_dir):
    """Pieces of each line, bytes that are no text alone escaped, as they go to a file."""
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), encode.token_line(F.col("line"), byte_pair_model()).alias("value"))


def sql_encode(spark, sf_dir):
    """Encoding and decoding in SQL text."""
    sql.register(spark, byte_pair_model())
    shown = "encode_hex(line)"
    words = "array_join(pretokenize(normalize_line(line), 0), ' ')"
    return spark.sql(f"SELECT doc_id, cast(line_no AS bigint) AS line_no, {shown} AS pieces, {words} AS tokens, decode_ids(encode_ids(line)) AS text FROM {{lines}}", lines=_lines(spark, sf_dir))


def sql_pieces(spark, sf_dir):
    """The table function beside each line."""
    sql.register(spark, byte_pair_model())
    return spark.sql("SELECT hex(p.piece) AS piece, p.id, count(*) AS n, min(p.pos) AS first FROM {lines} AS l, LATERAL pieces_of(l.line) AS p GROUP BY p.piece, p.id", lines=_lines(spark, sf_dir))


def merge_rank_table(spark, sf_dir):
    """Ranks of a vocabulary that has many pieces again and again: the first letters of documents."""
    part = lambda start, size: F.encode(F.substring(F.col("text"), F.lit(start), size), "UTF-8")
    docs = _table(spark, sf_dir, "documents")
    vocabulary = docs.select(F.col("doc_id").cast("int").alias("id"), part(1, F.expr("cast(1 + doc_id % 4 as int)")).alias("piece"), part(1, F.lit(1)).alias("u"), part(2, F.expr("cast(1 + doc_id % 2 as int)")).alias("v"))
    return encode.rank_table(vocabulary)


def rewrite_longest(spark, sf_dir):
    """The ten thousand most frequent words, rewritten wherever they stand, the longest at each place."""
    counts = _counts(spark, sf_dir).where(F.length("word") > 2)
    table = stats.by_frequency(counts).limit(10_000).select("word", F.concat(F.lit("<"), F.reverse("word"), F.lit(">")).alias("new"))
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.map_longest(T.normalize(F.col("line")), table).alias("line"))


def token_spans(spark, sf_dir):
    """Where each token stands in its line, and the line put together of what stands there."""
    found = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), encode.span_line(F.col("line"), byte_pair_model()).alias("t"))
    return found.select("doc_id", "line_no", "t.spans", F.col("t.text").cast("string").alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "raw_count": raw_count, "raw_count_maxbytes": raw_count_maxbytes, "pretokenize_cut0": _pretokenized(0), "pretokenize_cut1": _pretokenized(1),
        "pretokenize_reconstruct": _pretokenized(0, True), "normalize": normalize, "restore_spaces": restore_spaces, "space_runs": space_runs, "word_min_count": word_min_count,
        "first_n_lines": first_n_lines, "char_freq": char_freq, "char_coverage": char_coverage, "words_with_unk": words_with_unk, "pair_counts": pair_counts, "best_pair": best_pair,
        "byte_ngrams": byte_ngrams, "ngram_logprob": ngram_logprob, "sentences": sentences, "clean_text": clean_text, "strip_headings": strip_headings, "ascii_words": ascii_words,
        "byte_pieces": byte_piece_table, "vocab_layout": vocab_layout, "extra_tokens": extra_tokens, "piece_to_id": piece_to_id, "char_classes": char_classes, "escape": escaped,
        "encode_byte_pair": _encoded(byte_pair_model), "encode_char_pair": _encoded(char_pair_model), "encode_ngram": _encoded(ngram_model), "encode_sequence": _encoded(sequence_model),
        "decode_round_trip": _decoded(byte_pair_model), "decode_char_pair": _decoded(char_pair_model), "decode_ngram": _decoded(ngram_model), "decode_sequence": _decoded(sequence_model),
        "unescape": unescape, "repair_utf8": repair_utf8, "offset_map": offset_map, "han_split": han_split, "han_dictionary": han_dictionary, "han_dictionary_split": han_dictionary_split, "unicode_normalize": unicode_normalize,
        "frequency_lines": frequency_lines, "model_round_trip": model_round_trip, "train_byte_pair": train_byte_pair, "train_char_pair": train_char_pair, "train_ngram": train_ngram,
        "train_sequence": train_sequence, "tokenize_lines": tokenize_lines, "numbered_lines": numbered_lines, "model_source": model_source, "sql_encode": sql_encode, "sql_pieces": sql_pieces, "merge_rank_table": merge_rank_table,
        "rewrite_longest": rewrite_longest, "token_spans": token_spans,
    }
