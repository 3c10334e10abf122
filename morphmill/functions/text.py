"""Text functions over Columns: normalisation, pre-tokenization, character classes, escapes.

All are built-in expressions that stay in generated code, but for the named
Unicode normalisers, offsets, and repairs and escapes of bytes that aren't UTF-8.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphmill.functions.batches import in_slices, lengths

SPACE = "▁"
#: The code point ranges of the pre-tokenizer's classes.
LETTER_RANGES = (
    "41-5A 61-7A C0-D6 D8-F6 F8-85F 900-1FFF 2E80-2FFF 3040-33FF 4DC0-4DFF A000-D7FF FB00-FDFF "
    "FE70-FEFF FF21-FF3A FF41-FF5A FF66-FFDC 10000-10FFF"
)
HAN_RANGES = "3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF"
DIGIT_RANGES = "30-39 FF10-FF19"


def _class(ranges: str) -> str:
    """Code point ranges as the inside of a regex class, for Java and RE2 alike."""
    return "".join("-".join(rf"\x{{{end}}}" for end in r.split("-")) for r in ranges.split())


L, H, D = _class(LETTER_RANGES), _class(HAN_RANGES), _class(DIGIT_RANGES)


def pretokenizer_pattern(cut: int = 0, space: str = SPACE, han_apart: bool = False) -> str:
    """The one regular expression of a cut mode; its matches cover the whole text.

    cut 0: a space or a mark joins the letters after it, a space joins the marks
    after it. cut 1: spaces and marks stand alone, letters may have inner
    apostrophes. ``han_apart``: Han characters stand alone, not in runs.
    """
    s = "".join(rf"\x{{{ord(c):X}}}" for c in space)
    other, han = f"[^{s}{L}{D}{H}]", f"[{H}]" if han_apart else f"[{H}]+"
    if cut == 0:
        return f"(?:[{s}]|{other})?[{L}]+|[{D}]+|{han}|[{s}]?{other}+|[{s}]"
    if cut == 1:
        return f"[{L}]+(?:\\x{{27}}[{L}]+)*|[{D}]+|{han}|{other}|[{s}]"
    raise ValueError(f"no cut mode {cut}")


def normalize(text: Column, reconstruct: bool = False, space: str = SPACE) -> Column:
    """Spaces to the sentinel. Without ``reconstruct`` also strip them at both ends and merge runs.

    Only U+0020 counts; sentinels at the end of the input go too. A null stays null.
    """
    if reconstruct:
        return F.replace(text, F.lit(" "), F.lit(space))
    return F.rtrim(F.regexp_replace(F.ltrim(text), " +", space), F.lit(space))


_FOLD = {"NMT_NFKC": False, "NFKC": False, "NFKC_CF": True, "NMT_NFKC_CF": True}


def unicode_normalize(text: Column, name: str) -> Column:
    """NFKC, with case folding for names that end in CF; any other name means no change.

    NMT names are taken as NFKC: what else they did is not specified anywhere.
    """
    if name not in _FOLD:
        return text
    fold = _FOLD[name]

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t.casefold() if fold and t is not None else t
            t = unicodedata.normalize("NFKC", t)
            return unicodedata.normalize("NFKC", t.casefold()) if fold else t

        return s.map(one, na_action="ignore")

    return nfkc(text)


#: Entries of a rewriting table that is sent to the executors.
MOST_ENTRIES = 1_000_000


class Rewriter:
    """A table as a tree of characters: at each place the longest entry is replaced, the rest stays.

    Only places where an entry's first character stands are walked, and a walk
    goes on as long as some entry does: the work grows with the text, whatever
    the number of entries.
    """

    def __init__(self, table: Mapping[str, str]):
        self.tree: dict = {}
        for key, value in table.items():
            node = self.tree
            for c in key:
                node = node.setdefault(c, {})
            if key:
                node[""] = value
        self.heads = re.compile("[" + "".join(map(re.escape, sorted(self.tree))) + "]") if self.tree else None

    def __call__(self, text: str) -> str:
        out, done, at, n = [], 0, 0, len(text)
        while self.heads and (head := self.heads.search(text, at)):
            start = end = head.start()
            node, best, new = self.tree, 0, ""
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                if (value := node.get("")) is not None:
                    best, new = end, value
            if best:
                out += (text[done:start], new)
                done = at = best
            else:
                at = start + 1
        return "".join((*out, text[done:])) if out else text


def map_longest(text: Column, table: Mapping[str, str] | DataFrame) -> Column:
    """Rewrite by a table: at each place the longest entry that matches is replaced, the rest stays.

    A DataFrame's first two columns are the table; of repeated entries the
    smallest replacement counts. Its size is checked: it is sent to the executors.
    """
    if isinstance(table, DataFrame):
        key, value = table.columns[:2]
        own = table.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
        rows = own.limit(MOST_ENTRIES + 1).collect()
        if len(rows) > MOST_ENTRIES:
            raise ValueError(f"a rewriting table has {MOST_ENTRIES} entries at most")
        table = {r["k"]: r["v"] for r in rows}
    if not any(table):
        return text
    held = SparkSession.getActiveSession().sparkContext.broadcast(dict(table))
    built: list[Rewriter] = []

    @F.arrow_udf("string")
    def rewrite(rows: pa.Array) -> pa.Array:
        if not built:
            built.append(Rewriter(held.value))
        return pa.array([None if t is None else built[0](t) for t in rows.to_pylist()], pa.string())

    return rewrite(text)


def restore_spaces(text: Column, space: str = SPACE) -> Column:
    """Each sentinel to a space."""
    return F.replace(text, F.lit(space), F.lit(" "))


def pretokenize(text: Column, cut: int = 0, space: str = SPACE, han_apart: bool = False) -> Column:
    """Tokens of a normalised text; joined they are the text again. ``han_apart``: as with ``split_han`` after it."""
    return F.regexp_extract_all(text, F.lit(pretokenizer_pattern(cut, space, han_apart)), F.lit(0))


def split_han(tokens: Column) -> Column:
    """Tokens, with those of Han characters cut into single characters."""
    cut = F.transform(tokens, lambda t: F.when(t.rlike(f"^[{H}]"), F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))).otherwise(F.array(t)))
    return F.flatten(cut)


def is_han(char: Column) -> Column:
    return char.rlike(f"^[{H}]\\z")


def is_digit(char: Column) -> Column:
    return char.rlike(f"^[{D}]\\z")


def is_word_char(char: Column) -> Column:
    """Letters, Han and digits of the pre-tokenizer."""
    return char.rlike(f"^[{L}{H}{D}]\\z")


#: White space and control characters, which are neither word characters nor punctuation.
BLANK_RANGES = "00-20 7F-A0 1680 2000-200A 2028 2029 202F 205F 3000"
SPACE_RANGES = "09-0D 20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000"


def is_white_space(char: Column) -> Column:
    return char.rlike(f"^[{_class(SPACE_RANGES)}]\\z")


def is_punctuation(char: Column) -> Column:
    """One character that is no word character, white space or control character; such a character separates words."""
    return char.rlike(f"^[^{L}{H}{D}{_class(BLANK_RANGES)}]\\z")


is_separator = is_punctuation


def repair_utf8(data: Column) -> Column:
    """Bytes as text, with U+FFFD for each byte that isn't part of valid UTF-8."""

    @F.arrow_udf("string")
    def repair(rows: pa.Array) -> pa.Array:
        return pa.array([None if b is None else re.sub("[\udc80-\udcff]", "\ufffd", b.decode("utf-8", "surrogateescape")) for b in rows.to_pylist()], pa.string())

    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(repair(data))


def offsets_of(rows: pa.Array, reconstruct: bool = False, space: str = SPACE) -> tuple[pa.Array, pa.Array]:
    """Normalised texts and, for each byte of them and their ends, the byte of the given text that it comes from; all bytes of a batch at once."""
    mark = np.frombuffer(space.encode(), np.uint8)
    sizes, first = lengths(rows)
    # nulls have no bytes, and joining skips what a slice doesn't hold
    data = np.frombuffer(b"".join(rows.drop_null().cast(pa.binary()).to_pylist()), np.uint8)
    n, place = len(data), np.arange(len(data), dtype=np.int32)
    row_start = np.repeat(first[:-1], sizes).astype(np.int32)
    blank = data == 0x20
    # the byte that the character of each byte starts at
    start = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, place, 0)) if n else place
    counts = np.where(blank, len(mark), 1)
    text = rows.is_valid().to_numpy(zero_copy_only=False)
    if reconstruct:
        ends, told = sizes, text & (sizes > 0)
    else:
        # spaces at the start and after another one go
        counts[blank & ((place == row_start) | np.append([True], blank[:-1])[:n])] = 0
        # at the end spaces and sentinels go, those of the given text too; the end is where they begin
        opens = np.ones(max(n - len(mark) + 1, 0), bool)
        for k, b in enumerate(mark):
            opens &= data[k : k + len(opens)] == b
        loose = blank.copy()
        for k in range(len(mark)):
            loose[k : k + len(opens)] |= opens
        kept = np.append([-1], np.maximum.accumulate(np.where(loose, -1, place)) if n else place)[first[1:]]
        ends = np.maximum(kept + 1 - first[:-1], 0)
        counts[place - row_start >= np.repeat(ends, sizes)] = 0
        told = ends > 0
    written = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    out = np.repeat(data, counts)
    at = written[:-1][blank & (counts > 0)]
    for k, b in enumerate(mark):
        out[at + k] = b
    marks = np.insert(np.repeat(start - row_start, counts), written[first[1:]][told], ends[told])
    texts = pa.Array.from_buffers(pa.string(), len(rows), [pa.array(text).buffers()[1], pa.py_buffer(written[first].astype(np.int32)), pa.py_buffer(out)])
    return texts, pa.ListArray.from_arrays(pa.array(written[first] + np.append([0], np.cumsum(told)), pa.int32()), pa.array(marks, pa.int32()))


def normalize_with_offsets(text: Column, reconstruct: bool = False, space: str = SPACE) -> Column:
    """``struct<text, offsets>``: the normalised text, and for each of its bytes, and its end, the byte it comes from.

    The sentinel is one character. A text of spaces alone, or an empty one, has no offsets.
    """

    @F.arrow_udf("struct<text: string, offsets: array<int>>")
    def run(rows: pa.Array) -> pa.Array:
        return in_slices(rows, lambda some: pa.StructArray.from_arrays(offsets_of(some, reconstruct, space), ["text", "offsets"]))

    return F.when(text.isNotNull(), run(text))


def byte_to_piece(byte: Column) -> Column:
    """0..255 to ``<0xHH>``."""
    return F.concat(F.lit("<0x"), F.lpad(F.hex(byte.cast("long")), 2, "0"), F.lit(">"))


def piece_to_byte(piece: Column) -> Column:
    """``<0xHH>`` to 0..255, anything else to -1."""
    inner = F.regexp_extract(piece, r"^<0x([0-9A-F]{2})>\z", 1)
    return F.when(inner == "", F.lit(-1)).otherwise(F.conv(inner, 16, 10).cast("int"))


def escape(text: Column) -> Column:
    """Tab, newline, carriage return and backslash as ``\\xHH``; for UTF-8 text."""
    out = F.replace(text, F.lit("\\"), F.lit("\\x5C"))
    for char, code in (("\t", "09"), ("\n", "0A"), ("\r", "0D")):
        out = F.replace(out, F.lit(char), F.lit(f"\\x{code}"))
    return out


def escape_bytes(piece: bytes) -> str:
    """As ``escape``, for any bytes: those that aren't UTF-8 are escaped too."""
    out = []
    for c in piece.decode("utf-8", "surrogateescape"):
        if "\udc80" <= c <= "\udcff":
            out.append(f"\\x{ord(c) - 0xDC00:02X}")
        else:
            out.append(f"\\x{ord(c):02X}" if c in "\t\n\r\\" else c)
    return "".join(out)


def escape_array(pieces: Column) -> Column:
    """An array of pieces of any bytes as one line, each escaped, a space between."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if ps is None else " ".join(escape_bytes(p) for p in ps if p is not None) for ps in rows.to_pylist()], pa.string())

    return run(pieces)


def unescape(text: Column) -> Column:
    """The bytes that an escaped text stands for."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        return in_slices(rows, lambda some: pa.array([None if t is None else unescape_bytes(t) for t in some.to_pylist()], pa.binary()))

    return F.when(F.instr(text, "\\x") > 0, run(text)).otherwise(F.encode(text, "UTF-8"))


def escape_binary(data: Column) -> Column:
    """As ``escape``, for any bytes: those that aren't UTF-8 are escaped too."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if b is None else escape_bytes(b) for b in rows.to_pylist()], pa.string())

    return F.when(F.is_valid_utf8(data.cast("string")), escape(data.cast("string"))).otherwise(run(data))


def unescape_bytes(text: str) -> bytes:
    return re.sub(rb"\\x([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogateescape"))
