"""Subword models: specification, pieces, and their text format.

A model is small and lives on the driver; ``vocabulary`` gives it as a table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from morphmill.functions.text import SPACE, escape_bytes, unescape_bytes

#: Piece types, and the names of training methods, in the text format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BYTE_PAIR, CHAR_PAIR, NGRAM, SEQUENCE = "piece", "sentencepiece", "bytepiece", "naive"
METHODS = (BYTE_PAIR, CHAR_PAIR, NGRAM, SEQUENCE)


@dataclass(frozen=True)
class Piece:
    piece: bytes
    score: float = 0.0
    type: int = NORMAL
    u: bytes = b""
    v: bytes = b""


@dataclass(frozen=True)
class TrainSpec:
    """What a model is trained with. vocab_size counts all pieces but extra tokens."""

    method: str = NGRAM
    vocab_size: int = 8000
    character_coverage: float = 0.9995
    min_count: int = 32
    max_piece_size: int = 18
    unk_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    pad_id: int = -1
    unk_unicode: int = 0x2585
    unk_piece: str = "<unk>"
    bos_piece: str = "<s>"
    eos_piece: str = "</s>"
    pad_piece: str = "<pad>"
    extra_tokens: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"no training method {self.method!r}; there are {', '.join(METHODS)}")

    def meta(self) -> dict[int, Piece]:
        """Special pieces by id."""
        own = [(self.unk_id, self.unk_piece, UNKNOWN), (self.bos_id, self.bos_piece, CONTROL), (self.eos_id, self.eos_piece, CONTROL), (self.pad_id, self.pad_piece, CONTROL)]
        return {i: Piece(p.encode(), 0.0, t) for i, p, t in own if i >= 0}


@dataclass(frozen=True)
class NormalizerSpec:
    name: str = ""
    space: str = SPACE
    cut: int = 0
    reconstruct: bool = False


@dataclass(frozen=True)
class Model:
    spec: TrainSpec
    normalizer: NormalizerSpec
    pieces: tuple[Piece, ...] = field(default=())

    @staticmethod
    def empty() -> Model:
        return Model(TrainSpec(), NormalizerSpec())

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = [(i, bytearray(p.piece), p.score, p.type, bytearray(p.u), bytearray(p.v)) for i, p in enumerate(self.pieces)]
        return spark.createDataFrame(rows, "id int, piece binary, score double, type int, u binary, v binary")

    def ids(self) -> dict[bytes, int]:
        """Piece to id; of equal pieces the highest id."""
        return {p.piece: i for i, p in enumerate(self.pieces)}

    def to_text(self) -> str:
        s, n = self.spec, self.normalizer
        own = {k: getattr(s, k) for k in ("method", "vocab_size", "character_coverage", "min_count", "max_piece_size", "unk_id", "bos_id", "eos_id", "pad_id", "unk_unicode", "unk_piece", "bos_piece", "eos_piece", "pad_piece")}
        if s.extra_tokens:
            own["extra_tokens"] = ",".join(s.extra_tokens)
        lines = ["[CounterSpec]", *(f"{k}={v}" for k, v in own.items()), ""]
        lines += ["[NormalizerSpec]", f"name={n.name}", f"space={escape_bytes(n.space.encode())}", f"cut={n.cut}", f"reconstruct={int(n.reconstruct)}", ""]
        lines += ["[Pieces]", f"size={len(self.pieces)}"]
        # six significant digits, as the format has them; vocabulary() keeps full precision
        lines += ["\t".join((str(i), escape_bytes(p.piece), f"{p.score:g}", str(p.type), escape_bytes(p.u), escape_bytes(p.v))) for i, p in enumerate(self.pieces)]
        return "\n".join(lines) + "\n"

    @staticmethod
    def from_text(text: str) -> Model:
        """Read the text format; the place of a piece's line is its id, whatever its first field says."""
        section, values, pieces, size = "", {"CounterSpec": {}, "NormalizerSpec": {}}, [], None
        for line in text.split("\n"):
            if line in ("[CounterSpec]", "[NormalizerSpec]", "[Pieces]"):
                section = line[1:-1]
            elif section in values and "=" in line:
                k, v = line.split("=", 1)
                values[section][k] = v
            elif section == "Pieces" and line.startswith("size=") and size is None:
                size = int(line[5:])
            elif section == "Pieces" and line:
                f = line.split("\t")
                if len(f) < 4:
                    raise ValueError(f"a piece's line has fewer than four fields: {line!r}")
                u, v = (unescape_bytes(f[k]) if len(f) > k else b"" for k in (4, 5))
                pieces.append(Piece(unescape_bytes(f[1]), float(f[2]), int(f[3]), u, v))
        if size is None or size != len(pieces):
            raise ValueError(f"{len(pieces)} pieces where the model states {size}")
        spec = TrainSpec()
        known = {k: type(getattr(spec, k))(v) for k, v in values["CounterSpec"].items() if hasattr(spec, k) and k != "extra_tokens"}
        known["extra_tokens"] = tuple(x for x in values["CounterSpec"].get("extra_tokens", "").split(",") if x)
        n = values["NormalizerSpec"]
        norm = NormalizerSpec(n.get("name", ""), unescape_bytes(n.get("space", "")).decode(), int(n.get("cut") or 0), (n.get("reconstruct") or "0") != "0")
        return Model(replace(spec, **known), norm, tuple(pieces))

    def with_control_tokens(self, tokens: Iterable[str]) -> Model:
        """Append CONTROL pieces to a finished model, and count them in its vocab_size.

        Unlike ``extra_tokens`` in training, which leave vocab_size alone. A token
        equal to the padding piece becomes it. Models whose stated size isn't
        their number of pieces are refused.
        """
        tokens = [t for t in tokens if t]
        if not tokens:
            raise ValueError("no tokens to add")
        n = len(self.pieces)
        if self.spec.vocab_size != n:
            raise ValueError(f"vocab_size is {self.spec.vocab_size}, but there are {n} pieces")
        pads = [n + i for i, t in enumerate(tokens) if t == self.spec.pad_piece]
        spec = replace(self.spec, vocab_size=n + len(tokens), pad_id=pads[-1] if pads else self.spec.pad_id)
        return Model(spec, self.normalizer, self.pieces + tuple(Piece(t.encode(), 0.0, CONTROL) for t in tokens))


def layout(meta: dict[int, Piece], learned: list[Piece], size: int, extra: Iterable[str] = (), strict: bool = False) -> tuple[Piece, ...]:
    """Pieces by id: special ones at their ids, learned ones in the ids between, extra tokens at the end."""
    out, rest = [], iter(learned)
    for i in range(size):
        p = meta.get(i) or next(rest, None)
        if p is None:
            if strict:
                raise ValueError(f"no piece for id {i}: the corpus has too few pairs for {size} pieces")
            continue
        out.append(p)
    return (*out, *(Piece(t.encode(), 0.0, CONTROL) for t in extra))


def byte_pieces() -> list[Piece]:
    return [Piece(f"<0x{b:02X}>".encode(), 0.0, BYTE) for b in range(256)]
