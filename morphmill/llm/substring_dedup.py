"""Substring deduplication by unit hashing.

Units are lines, cut further at sentence ends. A unit's digest is that of its
normalised words (A-Z lower-cased, white space as one). Digests are grouped over
all documents; the occurrence with the smallest (id, unit number) stays. Of the
others, runs of neighbouring units that have enough words together are removed,
with their offsets in the original text. On request, long units are cut further
at words that their neighbours choose, so that equal passages inside different
long units have equal units too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, join_groups, spare_name
from morphmill.llm._text import char_offsets, lower, mix, run_hashes, slices, text_bytes, word_bounds, word_hashes

_STOP = np.isin(np.arange(256), list(b".!?"))
_SALT = np.uint64(0xA0761D6478BD642F)
#: Units of more words can be cut further, where a pair of words has the least hash of so many to either side.
LONG_UNIT, REACH = 16, 3
#: What is longer still has few different words and is cut in even parts.
LONG_PART, PART = 32, 8
UNITS = "id long, unit int, start long, end long, words int, h1 long, h2 long"


def inner_ends(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The last words of the parts of long units; ``last`` are those of the units."""
    n = len(hashes)
    counts = np.diff(last, prepend=-1)
    if n <= LONG_UNIT:
        return last
    pairs = mix(mix(hashes) + np.append(hashes[1:], hashes[:1]))
    unit = np.repeat(np.arange(len(last)), counts)
    # all words that have a say lie in the unit
    at = np.arange(REACH, n - REACH - 1)
    at = at[(unit[at - REACH] == unit[at + REACH + 1]) & (counts[unit[at]] > LONG_UNIT)]
    for d in range(1, REACH + 1):
        at = at[(pairs[at] < pairs[at - d]) & (pairs[at] <= pairs[at + d])]
    last = np.union1d(last, at)
    counts = np.diff(last, prepend=-1)
    inside = np.arange(n) - np.repeat(last - counts + 1, counts)
    even = np.flatnonzero((np.repeat(counts, counts) > LONG_PART) & (inside % PART == PART - 1))
    return np.union1d(last, even)


def unit_batches(batches: Iterator[pa.RecordBatch], cut_long: bool = False) -> Iterator[pa.RecordBatch]:
    """(id, text) to units; start and end in characters."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for i, j in slices(offsets):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            part = lower(part)
            starts, ends, doc = word_bounds(part, offs)
            if not len(starts):
                continue
            lines = np.concatenate(([0], np.cumsum(part == 10)))
            stop = np.ones(len(starts), bool)
            stop[:-1] = _STOP[part[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]]) | (doc[1:] != doc[:-1])
            last = np.flatnonzero(stop)
            hashes = word_hashes(part, starts, ends)
            last = inner_ends(hashes, last) if cut_long else last
            first = np.concatenate(([0], last[:-1] + 1))
            counts = last - first + 1
            chars = char_offsets(part)
            of = doc[first]
            unit = np.arange(len(first)) - np.searchsorted(of, of)
            base = chars[offs[of]]
            arrays = [
                pa.array(ids[i + of], pa.int64()), pa.array(unit, pa.int32()), pa.array(chars[starts[first]] - base), pa.array(chars[ends[last]] - base), pa.array(counts, pa.int32()),
                pa.array(run_hashes(hashes, first, counts).view(np.int64)), pa.array(run_hashes(mix(hashes ^ _SALT), first, counts).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "unit", "start", "end", "words", "h1", "h2"])


def _runs(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, units repeated) to the spans of runs of units with enough words."""
        for batch in batches:
            ids, spans, n_units, n_words, n_chars = [], [], [], [], []
            for i, units in zip(batch.column("id").to_pylist(), batch.column("units").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for u in units:
                    if runs and runs[-1][0] + 1 == u["unit"]:
                        now = runs[-1]
                        now[0], now[2], now[3], now[4] = u["unit"], u["end"], now[3] + u["words"], now[4] + 1
                    else:
                        runs.append([u["unit"], u["start"], u["end"], u["words"], 1])
                runs = [r for r in runs if r[3] >= least_words]
                if runs:
                    ids.append(i)
                    spans.append([{"start": r[1], "end": r[2]} for r in runs])
                    n_words.append(sum(r[3] for r in runs))
                    n_units.append(sum(r[4] for r in runs))
                    n_chars.append(sum(r[2] - r[1] for r in runs))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind), pa.array(n_units, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_chars, pa.int64())], ["id", "spans", "removed_units", "removed_words", "removed_chars"])

    return run


def repeated_spans(docs: DataFrame, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", cut_long: bool = False) -> DataFrame:
    """Per row of docs: its id, ``spans`` to remove (characters, end exclusive), ``removed_units``, ``removed_words``, ``removed_chars``.

    Null, empty and blank texts have no units. A row without id is ranked and
    changed by none: its units count for nobody, and it has no spans. Rows that
    repeat an id are one document: they get the same spans, which are right for
    rows that repeat the text too. Other columns are neither read nor returned.
    An empty table gives an empty result. Repeated units that have fewer than
    ``least_words`` together with their repeated neighbours stay. With
    ``cut_long``, units of more than LONG_UNIT words are cut further.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    with Scratch(docs.sparkSession) as scratch:
        units = scratch.save(text.mapInArrow(partial(unit_batches, cut_long=cut_long), UNITS), "units")
        # one row per digest and map task leaves for the shuffle, however often a unit occurs
        place = F.struct("id", "unit")
        groups = units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("latest"), F.count("*").alias("held"))
        groups = scratch.save(groups.where("first <> latest").select("h1", "h2", "first", "held"), "groups")
        again = join_groups(units, groups, ["h1", "h2"], "held").where("struct(id, unit) <> first")
        of_doc = again.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("unit", "start", "end", "words"))).alias("units"))
        schema = "id long, spans array<struct<start: long, end: long>>, removed_units long, removed_words long, removed_chars long"
        found = scratch.save(of_doc.mapInArrow(_runs(least_words), schema), "spans", keep=True)
    out = docs.select(F.col(id_col).cast("long").alias("id")).join(found, "id", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("removed_units", "removed_words", "removed_chars")]
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"), *zero)


def without_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without the spans that ``found`` has for their ids; ids are unique in both."""
    own, cut = spare_name(docs, "_id"), spare_name(docs, "_spans")
    spans = found.select(F.col(id_col).alias(own), F.col("spans").alias(cut))
    joined = docs.join(spans, docs[id_col] == F.col(own), "left")
    # what lies between the end of one span and the start of the next
    starts = f"concat(array(0L), transform({cut}, x -> x.end))"
    ends = f"concat(transform({cut}, x -> x.start), array(cast(char_length(`{text_col}`) as long)))"
    left = F.expr(f"array_join(zip_with({starts}, {ends}, (a, b) -> substring(`{text_col}`, cast(a as int) + 1, cast(b - a as int))), '')")
    text = F.when(F.size(cut) > 0, left).otherwise(F.col(text_col)).alias(text_col)
    return joined.select(*[text if c == text_col else docs[c] for c in docs.columns])
