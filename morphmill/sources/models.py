"""Model and dictionary files as Spark data sources, ``subword_model`` and ``word_frequencies``.

After ``register(spark)``, ``spark.read.format("subword_model").load(path)`` gives
a model's vocabulary, and ``df.write.format("subword_model").save(path)`` writes
one as a text file. Tasks write parts; the driver's commit puts them together by
id, or nothing is left of a failed write.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

from morphmill.functions.text import escape_bytes
from morphmill.model import Model, Piece
from morphmill.sources.text import parse_dictionary

VOCABULARY = "id int, piece binary, score double, type int, u binary, v binary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _read(path: str) -> str:
    store, own = _store(path)
    with store.open_input_stream(own) as f:
        return f.read().decode("utf-8", "surrogateescape")


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class ModelReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        for i, p in enumerate(Model.from_text(_read(self.path)).pieces):
            yield i, p.piece, float(p.score), p.type, p.u, p.v


class ModelWriter(DataSourceWriter):
    def __init__(self, path: str, header: str, overwrite: bool):
        self.path, self.header, self.overwrite = path, header, overwrite

    def write(self, rows: Iterator) -> Part:
        lines = []
        for r in rows:
            p = Piece(bytes(r["piece"]), r["score"], r["type"], bytes(r["u"] or b""), bytes(r["v"] or b""))
            lines.append("\t".join((str(r["id"]), escape_bytes(p.piece), f"{p.score:g}", str(p.type), escape_bytes(p.u), escape_bytes(p.v))))
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        store, own = _store(part)
        store.create_dir(own.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(own) as f:
            f.write("".join(x + "\n" for x in lines).encode("utf-8", "surrogateescape"))
        return Part(part, len(lines))

    def commit(self, messages: list[Part | None]) -> None:
        store, own = _store(self.path)
        try:
            if not self.overwrite and store.get_file_info(own).type != fs.FileType.NotFound:
                raise ValueError(f"{self.path} is there already")
            lines = [x for m in messages if m and m.rows for x in _read(m.path).removesuffix("\n").split("\n")]
            lines.sort(key=lambda x: int(x.split("\t", 1)[0]))
            if [int(x.split("\t", 1)[0]) for x in lines] != list(range(len(lines))):
                raise ValueError("the ids of a vocabulary are 0, 1, 2, ...")
            text = "\n".join([self.header, "[Pieces]", f"size={len(lines)}", *lines]) + "\n"
            with store.open_output_stream(own) as f:
                f.write(text.encode("utf-8", "surrogateescape"))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m:
                store, own = _store(m.path)
                if store.get_file_info(own).type != fs.FileType.NotFound:
                    store.delete_file(own)


class ModelSource(DataSource):
    """Options: ``path``, and for a write ``header``, what stands before the pieces (``header(model)``)."""

    @classmethod
    def name(cls) -> str:
        return "subword_model"

    def schema(self) -> str:
        return VOCABULARY

    def reader(self, schema) -> ModelReader:
        return ModelReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ModelWriter:
        return ModelWriter(self.options["path"], self.options.get("header", header(Model.empty())), overwrite)


class FrequencyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        for k, line in enumerate(_read(self.path).split("\n")):
            yield k, line


class FrequencySource(DataSource):
    """The lines of a ``word\\tfreq`` file with their numbers; ``read_dictionary`` has what counts of them."""

    @classmethod
    def name(cls) -> str:
        return "word_frequencies"

    def schema(self) -> str:
        return "line_no int, line string"

    def reader(self, schema) -> FrequencyReader:
        return FrequencyReader(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (ModelSource, FrequencySource):
        spark.dataSource.register(source)


def header(model: Model) -> str:
    """The lines of a model's text before its pieces."""
    return model.to_text().split("[Pieces]", 1)[0].removesuffix("\n")


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    register(spark)
    model.vocabulary(spark).write.format("subword_model").option("header", header(model)).mode("overwrite").save(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("subword_model").load(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of a dictionary file."""
    register(spark)
    return parse_dictionary(spark.read.format("word_frequencies").load(path))

