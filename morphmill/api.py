"""The two entry points: a pre-tokenizer without a model, and a tokenizer with one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphmill.functions.text import normalize, pretokenize, unicode_normalize
from morphmill.model import SEQUENCE, Model
from morphmill.operators import encode as enc
from morphmill.operators.han import dictionary_of, split_lines
from morphmill.sources.text import lines_of, parse_dictionary, read_model


class PreTokenizer:
    """Tokens of a text column, without a model."""

    def __init__(self, normalizer: str = "no", cut: int = 0, reconstruct: bool = False):
        self.normalizer, self.cut, self.reconstruct = normalizer, cut, reconstruct

    def tokenize(self, text: Column) -> Column:
        return pretokenize(normalize(unicode_normalize(text, self.normalizer), self.reconstruct), self.cut)


class Tokenizer:
    """Encode and decode text columns with a model."""

    def __init__(self, model: Model, dictionary: dict[bytes, float] | None = None, han: bool = False):
        self.model, self.dictionary, self.han = model, dictionary, han

    @staticmethod
    def load(spark: SparkSession, path: str, han_dictionary: str = "") -> Tokenizer:
        """A model file; ``han_dictionary`` is "no" for single characters, or a ``word\\tfreq`` file."""
        model = read_model(spark, path)
        if not han_dictionary or han_dictionary == "no":
            return Tokenizer(model, None, han_dictionary == "no")
        text = spark.read.text(han_dictionary, wholetext=True)
        return Tokenizer(model, dictionary_of(parse_dictionary(lines_of(text, "value"))), True)

    def with_encoded(self, rows: DataFrame, text_col: str, out: str = "encoded") -> DataFrame:
        """rows with the encoded text, in Han mode too."""
        if not self.han:
            return rows.withColumn(out, enc.encode(F.col(text_col), self.model))
        ready = rows.withColumn("_text", enc.normalized(F.col(text_col), self.model))
        split = split_lines(ready, self.dictionary, self.model.normalizer.cut, "_text")
        return split.withColumn(out, enc.encode(F.col(text_col), self.model, F.col("tokens"))).drop("_text", "tokens")

    def encode(self, text: Column) -> Column:
        return enc.encode(text, self.model)

    def encode_as_ids(self, text: Column) -> Column:
        return F.transform(self.encode(text), lambda x: x["id"])

    def encode_as_pieces(self, text: Column) -> Column:
        return enc.tokenize(text, self.model)

    def decode(self, rows: DataFrame, *keys: str, ids: str = "ids") -> DataFrame:
        return enc.decode(rows, self.model, *keys, ids=ids)

    def piece_to_id(self, piece: str | bytes) -> int:
        piece = piece.encode() if isinstance(piece, str) else piece
        return self.model.ids().get(piece, -1 if self.model.spec.method == SEQUENCE else self.model.spec.unk_id)

    def id_to_piece_bytes(self, i: int) -> bytes:
        return self.model.pieces[i].piece

    def id_to_piece(self, i: int) -> str:
        return self.id_to_piece_bytes(i).decode("utf-8", "replace")

    def vocab_size(self) -> int:
        return len(self.model.pieces)

    @property
    def method(self) -> str:
        return self.model.spec.method
