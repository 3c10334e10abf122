"""Small models and literal inputs of queries, and of their oracles."""

from __future__ import annotations

from morphmill.model import BYTE_PAIR, CHAR_PAIR, NGRAM, NORMAL, SEQUENCE, Model, NormalizerSpec, Piece, TrainSpec, byte_pieces, layout

MERGES = [("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("a", "n"), ("o", "n"), ("in", "g"), ("an", "d"), ("e", "n"), ("l", "l"), ("t", "i"), ("o", "u"), ("e", "s"), ("a", "t"), ("r", "e"), ("l", "e")]


def byte_pair_model() -> Model:
    """A small byte-level model: all bytes, and a few merges."""
    learned = [Piece(bytes([b]), -float(b)) for b in range(256)]
    learned += [Piece((u + v).encode(), -float(256 + i), NORMAL, u.encode(), v.encode()) for i, (u, v) in enumerate(MERGES)]
    spec = TrainSpec(BYTE_PAIR, 3 + len(learned))
    return Model(spec, NormalizerSpec(), layout(spec.meta(), learned, spec.vocab_size))


def char_pair_model() -> Model:
    spec = TrainSpec(CHAR_PAIR, 3 + 256 + len(MERGES) + 26)
    meta = spec.meta() | {3 + i: p for i, p in enumerate(byte_pieces())}
    names = [u + v for u, v in MERGES] + [chr(97 + i) for i in range(26)]
    return Model(spec, NormalizerSpec(), layout(meta, [Piece(n.encode(), -float(i)) for i, n in enumerate(names)], spec.vocab_size))


def ngram_model() -> Model:
    meta = TrainSpec(NGRAM).meta() | {3 + i: p for i, p in enumerate(byte_pieces())}
    names = [u + v for u, v in MERGES] + [chr(97 + i) for i in range(26)] + ["▁", "▁the", "▁and"]
    learned = [Piece(n.encode(), float(1000 - 7 * i)) for i, n in enumerate(names)]
    own = layout(meta, learned, len(meta) + len(learned))
    return Model(TrainSpec(NGRAM, len(own)), NormalizerSpec(), own)


def sequence_model() -> Model:
    learned = [Piece(bytes([b]), 0.0, 6) for b in range(256)] + [Piece((u + v).encode(), -float(i), NORMAL, u.encode(), v.encode()) for i, (u, v) in enumerate(MERGES)]
    return Model(TrainSpec(SEQUENCE, len(learned)), NormalizerSpec(space=""), tuple(learned))


#: Han characters that stand for the vowels of lines.
HAN_VOWELS = "他是英国人"
