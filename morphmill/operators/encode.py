"""Encoding and decoding of text columns with a model.

Normalisation is built-in expressions; segmentation and decoding run in Arrow
batches over a broadcast model, without a shuffle. Where no piece can span the
start of a space mark, a text's encoding is that of its parts, and a task encodes
each different part once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphmill.functions.batches import in_slices, lengths
from morphmill.functions.text import SPACE, escape_bytes, normalize, offsets_of, restore_spaces, unicode_normalize
from morphmill.model import BYTE, BYTE_PAIR, CHAR_PAIR, CONTROL, NGRAM, NORMAL, SEQUENCE, UNKNOWN, Model
from morphmill.operators.segment import Unigram, cut_before, merge_chars, merge_ids, unspanned

ENCODED, IDS = "array<struct<piece: binary, id: int>>", "array<int>"


def merge_ranks(model: Model) -> dict[tuple[int, int], int]:
    """(id of u, id of v) to the id of the piece made of them; ids are those known at the piece's place."""
    ids: dict[bytes, int] = {}
    ranks = {}
    for i, p in enumerate(model.pieces):
        ids[p.piece] = i
        if p.u and p.v and p.u in ids and p.v in ids:
            ranks[ids[p.u], ids[p.v]] = i
    return ranks


def rank_table(vocabulary: DataFrame) -> DataFrame:
    """(l, r, id), as ``merge_ranks`` of a vocabulary table (id, piece, u, v) of any size.

    Each part is looked up as of its row: the latest piece equal to it so far,
    the row's own too. Definitions and look-ups of a string stand in one order,
    and a window carries the last definition on.
    """
    defined = vocabulary.select(F.col("piece").alias("name"), F.col("id").alias("at"), F.lit("").alias("side"), F.col("id").alias("own"))
    both = vocabulary.where("octet_length(u) > 0 and octet_length(v) > 0")
    asked = [both.select(F.col(c).alias("name"), F.col("id").alias("at"), F.lit(c).alias("side"), F.lit(None).cast("int").alias("own")) for c in ("u", "v")]
    # of one row, what it defines comes before what it asks for
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("name").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = defined.union(asked[0]).union(asked[1]).withColumn("own", last).where("side <> ''")
    sides = [F.max(F.when(F.col("side") == c, F.col("own"))).alias(n) for c, n in (("u", "l"), ("v", "r"))]
    known = found.groupBy("at").agg(*sides).where("l is not null and r is not null")
    return known.groupBy("l", "r").agg(F.max("at").alias("id"))


def piece_ids(pieces: DataFrame, vocabulary: DataFrame, unknown: int | None) -> DataFrame:
    """pieces with ``id``: an exact lookup, the highest id of equal pieces, else ``unknown``."""
    known = vocabulary.groupBy("piece").agg(F.max("id").alias("id"))
    return pieces.join(known, "piece", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


class _Lookups:
    """What one model needs in a task, and what it has already encoded there."""

    #: Parts of texts whose encodings are kept in each of two generations.
    KEEP = 100_000

    def __init__(self, model: Model):
        self.model, self.method = model, model.spec.method
        self.ids = model.ids()
        self.unk = model.spec.unk_id
        self.mark = " " if self.method == SEQUENCE else model.normalizer.space or SPACE
        #: Encoded items by number, as rows of a table, and their numbers.
        self.items: list[tuple[bytes, int]] = []
        self.numbers: dict[tuple[bytes, int], int] = {}
        self.known: dict[str, list[int] | None] = {}
        #: What was known when ``known`` was last full; what is used of it moves on.
        self.older: dict[str, list[int] | None] = {}
        if self.method == BYTE_PAIR:
            self.ranks = merge_ranks(model)
            self.bytes = [self.ids.get(bytes([b]), self.unk) for b in range(256)]
            spans = [model.pieces[i].piece for i in self.ranks.values()]
        elif self.method == CHAR_PAIR:
            self.scores = {}
            for p in model.pieces:
                try:
                    self.scores[p.piece.decode()] = p.score
                except UnicodeDecodeError:
                    pass
            spans = [p.encode() for p in self.scores]
        elif self.method == NGRAM:
            self.unigram = Unigram({p.piece: p.score for p in model.pieces if p.type == NORMAL})
            spans = list(self.unigram.weights)
        else:
            # pieces without parts, such as control tokens, are made by no merge
            merges = [(i, p.u, p.v) for i, p in enumerate(model.pieces) if i >= 256 and p.u and p.v]
            self.ranks = {(self.ids[u], self.ids[v]): i for i, u, v in merges if u in self.ids and v in self.ids}
            spans = [model.pieces[i].piece for i in self.ranks.values()]
        #: Whether a text's encoding is that of its parts between marks: no piece spans the start of a mark.
        self.cuts = unspanned(spans, self.mark.encode())

    def _or_bytes(self, piece: bytes) -> list[tuple[bytes, int]]:
        i = self.ids.get(piece, self.unk)
        if i != self.unk:
            return [(piece, i)]
        out = []
        for b in piece:
            name = f"<0x{b:02X}>".encode()
            out.append((name, self.ids.get(name, self.unk)))
        return out

    def _whole(self, text: str, pieces: bool) -> tuple[list[tuple[bytes, int]], bool]:
        """A text's items without regard to its parts, and whether another cut was nearly as good."""
        if self.method == CHAR_PAIR:
            return [x for p in merge_chars(text, self.scores) for x in self._or_bytes(p.encode())], False
        if self.method == NGRAM:
            own, tie = self.unigram.cut_and_tie(text.encode())
            return [(p, -1) for p in own] if pieces else [x for p in own for x in self._or_bytes(p)], tie
        start = [self.bytes[b] for b in text.encode()] if self.method == BYTE_PAIR else list(text.encode())
        return [(self.model.pieces[i].piece, i) for i in merge_ids(start, self.ranks)], False

    def _numbered(self, items: list[tuple[bytes, int]]) -> list[int]:
        out = []
        for x in items:
            k = self.numbers.get(x)
            if k is None:
                k = self.numbers[x] = len(self.items)
                self.items.append(x)
            out.append(k)
        return out

    def _part(self, part: str, pieces: bool) -> list[int] | None:
        """Numbers of a part's items; a part is encoded once. None if another cut was nearly as good."""
        own = self.known.get(part, self)
        if own is self:
            own = self.older.get(part, self)
            if own is self:
                items, tie = self._whole(part, pieces)
                own = None if tie else self._numbered(items)
            if len(self.known) >= self.KEEP:
                self.known, self.older = {}, self.known
            self.known[part] = own
        return own

    def encode(self, text: str, pieces: bool = False) -> list[int]:
        """Numbers of a text's items; with ``pieces`` those before the fall-back to bytes.

        A sum of weights over a whole text is rounded otherwise than over a
        part, so texts with parts of nearly equal cuts are encoded as a whole.
        """
        if self.cuts:
            own = [self._part(part, pieces) for part in cut_before(text, self.mark)]
            if all(x is not None for x in own):
                return [k for x in own for k in x]
        return self._numbered(self._whole(text, pieces)[0])

    def encode_all(self, texts: pa.Array, pieces: bool = False) -> pa.ListArray:
        """``encode`` of each text of a batch: its different parts are looked up, and all of them take what was found. A null has no items."""
        if not self.cuts:
            return pa.array([[] if t is None else self.encode(t, pieces) for t in texts.to_pylist()], pa.list_(pa.int32()))
        cut = pc.split_pattern(texts, self.mark)
        counts, first = lengths(cut)
        coded = cut.flatten().dictionary_encode()
        # a text's first part has no mark before it
        codes = coded.indices.to_numpy() * 2
        codes[first[:-1][counts > 0]] += 1
        used = np.bincount(codes, minlength=2 * len(coded.dictionary)) > 0
        names = coded.dictionary.to_pylist()

        def of(code: int) -> list[int] | None:
            part = names[code >> 1] if code & 1 else self.mark + names[code >> 1]
            return self._part(part, pieces) if part else []

        found = [of(c) for c in np.flatnonzero(used).tolist()]
        own = pa.array([x or [] for x in found], pa.list_(pa.int32()))
        ranks = (np.cumsum(used) - 1)[codes]
        taken = own.take(pa.array(ranks))
        out = pa.ListArray.from_arrays(taken.offsets.take(pa.array(first)), taken.flatten())
        ties = np.array([x is None for x in found], bool)
        if not ties.any():
            return out
        rows = np.unique(np.searchsorted(first, np.flatnonzero(ties[ranks]), "right") - 1)
        whole = [self._numbered(self._whole(texts[i].as_py(), pieces)[0]) for i in rows.tolist()]
        at = np.arange(len(texts))
        at[rows] = len(texts) + np.arange(len(rows))
        return pa.concat_arrays([out, pa.array(whole, pa.list_(pa.int32()))]).take(pa.array(at))


def normalized(text: Column, model: Model) -> Column:
    """A text as the model's encoder sees it; the sequence method takes texts as they are."""
    if model.spec.method == SEQUENCE:
        return text
    n = model.normalizer
    return normalize(unicode_normalize(text, n.name), n.reconstruct, n.space or SPACE)


def segmenter(model: Model, kind: str = ENCODED, pieces: bool = False, show: Callable[[bytes], str] | None = None, separator: str = ""):
    """An Arrow UDF over rows of parts to their items. A task builds the lookups once.

    ``kind`` is what a row gives: items, ids or pieces; with ``show`` a string of
    its pieces as shown, ``separator`` between them.
    """
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)
    built: list[_Lookups] = []

    def of_slice(rows: pa.Array) -> pa.Array:
        own = built[0]
        found = own.encode_all(rows.flatten(), pieces)
        # items are looked up by number, a table of the different ones
        at, ends = found.flatten(), found.offsets.take(pa.array(lengths(rows)[1]))
        if show:
            return pc.binary_join(pa.ListArray.from_arrays(ends, pa.array([show(p) for p, _ in own.items], pa.string()).take(at)), separator)
        names = None if kind == IDS else pa.array([p for p, _ in own.items], pa.binary()).take(at)
        ids = None if pieces else pa.array([i for _, i in own.items], pa.int32()).take(at)
        return pa.ListArray.from_arrays(ends, ids if names is None else names if ids is None else pa.StructArray.from_arrays([names, ids], ["piece", "id"]))

    @F.arrow_udf("string" if show else kind)
    def run(rows: pa.Array) -> pa.Array:
        if not built:
            built.append(_Lookups(held.value))
        return in_slices(rows, of_slice)

    return run


def _segmented(text: Column, model: Model, tokens: Column | None, *how) -> Column:
    return F.when(text.isNotNull(), segmenter(model, *how)(F.array(normalized(text, model)) if tokens is None else tokens))


def encode(text: Column, model: Model, tokens: Column | None = None) -> Column:
    """``array<struct<piece, id>>`` of a text, or of given ``tokens`` of it, which merges don't cross. A null stays null."""
    return _segmented(text, model, tokens)


def encode_ids(text: Column, model: Model, tokens: Column | None = None) -> Column:
    """The ids of ``encode`` alone."""
    return _segmented(text, model, tokens, IDS)


def tokenize(text: Column, model: Model, tokens: Column | None = None) -> Column:
    """Pieces of a text; for the n-gram method those before the fall-back to bytes."""
    return _segmented(text, model, tokens, "array<binary>", True)


def token_line(text: Column, model: Model, show: Callable[[bytes], str] = escape_bytes, separator: str = " ", fallen: bool = False, tokens: Column | None = None) -> Column:
    """The pieces of ``tokenize`` as one string: each as shown, escaped by default, and a separator between. ``fallen``: those of ``encode``."""
    return _segmented(text, model, tokens, "string", not fallen, show, separator)


def in_hex(piece: bytes) -> str:
    """A piece's bytes in hexadecimal, with its ends marked."""
    return f"<{piece.hex().upper()}>"


def _spans(texts: pa.Array, own: _Lookups, alone: list[int]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Of all tokens of a batch: where each text's begin, pieces, ids, and the places of the text's bytes where each begins and ends."""
    n = own.model.normalizer
    if own.method == SEQUENCE:
        sizes = lengths(texts)[0]
        ready, counts = texts, sizes + (sizes > 0)
        first_mark = np.concatenate(([0], np.cumsum(counts)))
        marks = np.arange(first_mark[-1]) - np.repeat(first_mark[:-1], counts)
    else:
        ready, offsets = offsets_of(texts, n.reconstruct, n.space or SPACE)
        first_mark, marks = lengths(offsets)[1], offsets.flatten().to_numpy()
    found = own.encode_all(ready)
    counts, first = lengths(found)
    at = found.flatten()
    pieces = pa.array([p for p, _ in own.items], pa.binary()).take(at)
    ids = pa.array([i for _, i in own.items], pa.int32()).take(at)
    # all tokens at once: where each ends in its own text, then what that text's offsets say there
    sizes = np.where(np.isin(ids.to_numpy(), alone), 1, lengths(pieces)[0])
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    shift = np.repeat(first_mark[:-1] - ends[first[:-1]], counts)
    return first, pieces, ids, marks[ends[:-1] + shift], marks[ends[1:] + shift]


def _span_udf(model: Model, kind: str, then: Callable[..., pa.Array]):
    """An Arrow UDF of texts: ``then`` of a slice of them and its spans."""
    if model.spec.method != SEQUENCE and model.normalizer.name:
        raise ValueError("named Unicode normalisers have no offsets")
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)
    alone = [i for i, p in enumerate(model.pieces) if p.type == BYTE and model.spec.method != SEQUENCE]
    built: list[_Lookups] = []

    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        if not built:
            built.append(_Lookups(held.value))
        return in_slices(rows, lambda some: then(some, *_spans(some, built[0], alone)))

    return run


def token_spans(text: Column, model: Model) -> Column:
    """``array<struct<piece, id, start, end>>`` of a text: its tokens, and the bytes of the text that each stands for.

    The normaliser's offsets are taken where tokens end. Neighbouring spans
    touch: spaces that were merged or stripped inside belong to the token
    before. For models whose pieces cover all bytes. A null stays null.
    """

    def listed(_, first, pieces, ids, starts, ends):
        bounds = [pa.array(x, pa.int32()) for x in (starts, ends)]
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pieces, ids, *bounds], ["piece", "id", "start", "end"]))

    return F.when(text.isNotNull(), _span_udf(model, "array<struct<piece: binary, id: int, start: int, end: int>>", listed)(text))


def span_line(text: Column, model: Model) -> Column:
    """``struct<spans: string, text: binary>``: the spans of ``token_spans`` as ``start:end``, commas between, and what stands at them, put together."""

    def shown(texts, first, pieces, ids, starts, ends):
        pairs = pc.binary_join_element_wise(pa.array(starts).cast(pa.string()), pa.array(ends).cast(pa.string()), ":")
        data = np.frombuffer(b"".join(texts.drop_null().cast(pa.binary()).to_pylist()), np.uint8)
        sizes = ends.astype(np.int64) - starts
        done = np.concatenate(([0], np.cumsum(sizes)))
        row_start = np.repeat(lengths(texts)[1][:-1], np.diff(first))
        slices = data[np.repeat(row_start + starts - done[:-1], sizes) + np.arange(done[-1])]
        joined = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(done[first].astype(np.int32)), pa.py_buffer(slices)])
        return pa.StructArray.from_arrays([pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pairs), ","), joined], ["spans", "text"])

    return F.when(text.isNotNull(), _span_udf(model, "struct<spans: string, text: binary>", shown)(text))


def decoded_pieces(model: Model) -> list[bytes]:
    """What each id decodes to, and at the end what an id decodes to that the model doesn't have."""
    if model.spec.method == SEQUENCE:
        return [p.piece for p in model.pieces] + [b""]
    out = []
    for p in model.pieces:
        byte = re.fullmatch(rb"<0x([0-9A-F]{2})>", p.piece) if p.type == BYTE else None
        out.append(bytes([int(byte[1], 16)]) if byte else b"" if p.type in (UNKNOWN, CONTROL) else p.piece)
    return out + [model.pieces[model.spec.unk_id].piece if 0 <= model.spec.unk_id < len(model.pieces) else b""]


def decoded(ids: Column, model: Model) -> Column:
    """The text of an array of ids, without a shuffle: a lookup in the broadcast model.

    Ids that the model doesn't have decode to its unknown piece, or to nothing
    for the sequence method; null ids to nothing. Bytes that aren't UTF-8 become
    U+FFFD. A null array is an empty text.
    """
    text = F.make_valid_utf8(joined_pieces(model)(ids).cast("string"))
    return text if model.spec.method == SEQUENCE else restore_spaces(text, model.normalizer.space or SPACE)


def joined_pieces(model: Model):
    """An Arrow UDF of arrays of ids to the bytes they decode to."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(decoded_pieces(model))
    built: list[pa.Array] = []

    def of_slice(rows: pa.Array) -> pa.Array:
        table, flat = built[0], rows.flatten().cast(pa.int64())
        n = len(table) - 2
        at = flat.fill_null(n + 1).to_numpy(zero_copy_only=False)
        known = (at >= 0) & (at < n) | (flat.is_null().to_numpy(zero_copy_only=False))
        pieces = table.take(pa.array(np.where(known, at, n)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(lengths(rows)[1], pa.int32()), pieces), b"")

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        if not built:
            built.append(pa.array([*held.value, b""], pa.binary()))
        return in_slices(rows, of_slice)

    return run


def decode(encoded: DataFrame, model: Model, *keys: str, ids: str = "ids") -> DataFrame:
    """keys and ``text`` of each row of (keys, ids), as ``decoded``; rows with the same keys stay rows."""
    return encoded.select(*keys, decoded(F.col(ids), model).alias("text"))
