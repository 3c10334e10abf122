"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses where chunks of two
lines or more end, so that an inserted or lost line moves the chunks around it
only. Chunks that occur more than once are found by a hash over all documents;
each is then compared, byte by byte, with the occurrence that stays, and removed
if they are equal.

Where a chunk of a partition ends depends on lines outside a short repeat, so such
chunks alone miss most repeats of few lines. ``repeated_runs`` therefore lets
chunks overlap: the rolling hash of a line and the next says whether a chunk opens
there and whether one ends there, from what lies inside of the chunk only. Chunks
that are equal in bytes to the one that stays are then extended to both sides, as
far as the lines there are equal too. ``repeated_passages`` takes any two
neighbouring lines instead, which needs no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, join_groups
from morphmill.llm._text import _powers, char_offsets, line_bounds, line_hashes, mix, run_hashes, slices, text_bytes

#: A chunk of two lines or more ends after a line with the chance of one in so many.
EVERY = 2
#: Of the overlapping chunks, one place in so many opens none, and one in so many ends none.
REFUSE = 32
_OPENS, _ENDS = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x52DCE729DA3ED5B7)


def chunk_bounds(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The last lines of chunks: those where the hash of a line and the one before says so, and each text's last.

    No chunk has one line, but that of a text of one line.
    """
    before = np.zeros(len(hashes), np.uint64)
    same = doc[1:] == doc[:-1]
    before[1:][same] = mix(hashes[:-1][same])
    ends = mix(mix(before) + hashes) % np.uint64(EVERY) == 0
    # not after a text's first line; of neighbouring ends the first, third, ... stay
    ends[0] = False
    ends[1:] &= same
    at = np.arange(len(ends))
    ends &= (at - np.maximum.accumulate(np.where(ends, -1, at))) % 2 == 1
    final = np.append(~same, True)
    # what would be a last chunk of one line joins the one before
    ends[:-1] &= ~final[1:]
    return np.flatnonzero(ends | final)


def line_pairs(hashes: np.ndarray, doc: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, hash) of each line that is not empty and the next such line of its text; empty ones may lie between."""
    at = np.flatnonzero(full)
    at, after = at[:-1], at[1:]
    same = doc[at] == doc[after]
    at, after = at[same], after[same]
    return at, after, mix(mix(mix(hashes[at]) + hashes[after]) + (after - at).astype(np.uint64))


def overlapping_chunks(hashes: np.ndarray, doc: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first line, last line, line before, line after, hash) of chunks of two or more lines that are not empty; -1 for no line before or after.

    Empty lines may lie inside. The hash of two neighbours decides whether a
    chunk opens with them and whether one ends with them; a text's last line ends all.
    """
    lines = np.flatnonzero(full)
    at, after, rolling = line_pairs(hashes, doc, full)
    last = np.ones(len(at), bool)
    last[:-1] = doc[at[1:]] != doc[at[:-1]]
    ends = np.flatnonzero(last | (mix(rolling ^ _ENDS) % np.uint64(REFUSE) != 0))
    opens = np.flatnonzero(mix(rolling ^ _OPENS) % np.uint64(REFUSE) != 0)
    first, final = at[opens], after[ends[np.searchsorted(ends, opens)]] if len(opens) else opens
    r, inverse = _powers(len(hashes) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * r[: len(hashes)], dtype=np.uint64)))
    own = mix((running[final + 1] - running[first]) * inverse[first] + (final - first).astype(np.uint64))

    def neighbour(line: np.ndarray, step: int) -> np.ndarray:
        k = np.searchsorted(lines, line) + step
        there = lines[np.clip(k, 0, max(len(lines) - 1, 0))] if len(lines) else line
        return np.where((k >= 0) & (k < len(lines)) & (doc[there] == doc[line]), there, -1)

    return first, final, neighbour(first, -1), neighbour(final, 1), own


#: Of a chunk: bytes, characters and lines where it starts and ends (exclusive), and where it would with one more line to the left or right.
RUN_FIELDS = [f"{kind}{edge}" for kind in ("", "char_", "line_") for edge in ("start", "end", "left", "right")]
RUN = pa.struct([*((f, pa.int32()) for f in RUN_FIELDS), ("h", pa.int64())])
RUNS = f"id long, n_lines long, n_chunks long, chunks array<struct<{', '.join(f'{f}: int' for f in RUN_FIELDS)}, h: long>>"


def run_batches(batches: Iterator[pa.RecordBatch], bits: int = 64) -> Iterator[pa.RecordBatch]:
    """(id, text) to RUNS: a text's ``overlapping_chunks``."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        n_lines, lists, values, at = [], [0], [], 0
        for i, j in slices(offsets):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, doc = line_bounds(part, offs)
            first, last, left, right, own = overlapping_chunks(line_hashes(part, starts, ends), doc, ends > starts)
            left, right = np.where(left < 0, first, left), np.where(right < 0, last, right)
            of, chars, zero = doc[first], char_offsets(part), np.searchsorted(doc, doc[first])
            places = [starts[first], ends[last], starts[left], ends[right]]
            values.append([p - offs[of] for p in places] + [chars[p] - chars[offs[of]] for p in places] + [first - zero, last + 1 - zero, left - zero, right + 1 - zero, (own >> np.uint64(64 - bits)).view(np.int64)])
            n_lines.append(np.bincount(doc, minlength=j - i))
            lists += (at + np.searchsorted(of, np.arange(1, j - i + 1))).tolist()
            at += len(of)
        columns = [pa.array(np.concatenate(x) if values else [], RUN.field(k).type) for k, x in enumerate(zip(*values, strict=True) if values else [()] * len(RUN))]
        chunks = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN)))
        counts = pa.array(np.diff(lists), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(n_lines) if n_lines else [], pa.int64()), counts, chunks], ["id", "n_lines", "n_chunks", "chunks"])


KIND = pa.struct([("start", pa.int64()), ("bytes", pa.int64()), ("char", pa.int64()), ("char_end", pa.int64()), ("line", pa.int64()), ("lines", pa.int64()), ("h", pa.int64())])


def chunk_batches(batches: Iterator[pa.RecordBatch], pairs: bool = False, bits: int = 64) -> Iterator[pa.RecordBatch]:
    """(id, text) to a row per text: its lines, and its chunks of two lines or more; offsets in bytes and characters.

    With ``pairs``, the chunks that are listed are those of three lines or more, two of them not empty, and all ``line_pairs``.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        n_lines, n_chunks, lists, values, at = [], [], [0], [], 0
        for i, j in slices(offsets):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, doc = line_bounds(part, offs)
            hashes = line_hashes(part, starts, ends)
            last = chunk_bounds(hashes, doc)
            first = np.concatenate(([0], last[:-1] + 1))
            counts = last - first + 1
            chunk = run_hashes(hashes, first, counts)
            many = counts > 1
            n_chunks.append(np.bincount(doc[first[many]], minlength=j - i))
            if pairs:
                full = ends > starts
                many = (counts > 2) & (np.add.reduceat(full.astype(np.int64), first) > 1)
                own = line_pairs(hashes, doc, full)
                first, last, chunk = (np.concatenate((x[many], y)) for x, y in zip((first, last, chunk), own, strict=True))
                order = np.argsort(first, kind="stable")
                first, last, chunk = first[order], last[order], chunk[order]
            else:
                first, last, chunk = first[many], last[many], chunk[many]
            of, chars = doc[first], char_offsets(part)
            n_lines.append(np.bincount(doc, minlength=j - i))
            line = first - np.searchsorted(doc, of)
            values.append([starts[first] - offs[of], ends[last] - starts[first], chars[starts[first]] - chars[offs[of]], chars[ends[last]] - chars[offs[of]], line, last - first + 1, (chunk >> np.uint64(64 - bits)).view(np.int64)])
            lists += (at + np.searchsorted(of, np.arange(1, j - i + 1))).tolist()
            at += len(of)
        columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*values, strict=True)] if values else [pa.array([], pa.int64())] * len(KIND)
        chunks = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(KIND)))
        counted = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n_lines, n_chunks)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *counted, chunks], ["id", "n_lines", "n_chunks", "chunks"])


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Per row of docs: its id, ``n_lines``, ``n_chunks`` (of two lines or more), ``spans`` to remove (characters, end exclusive), ``removed_lines``.

    Of equal chunks the one with the smallest (id, offset) stays. A null text is
    empty, which is one empty line. A row without id has no spans and none is
    removed for it. Rows that repeat an id are one document. Chunks of one hash
    that are unequal are told apart by their bytes; ``hash_bits`` is for tests of
    that. Other columns are neither read nor returned. An empty table gives an
    empty result.
    """
    return _repeated(docs, id_col, text_col, pairs=False, bits=hash_bits)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``repeated_chunks``, but also any two neighbouring lines that occur before are removed, wherever chunks end.

    Neighbours are lines that are not empty; empty ones may lie between. A
    chunk that overlaps the equal one that stays is not removed. Spans that
    overlap or touch are one. Each line that is removed occurs earlier too.
    """
    return _repeated(docs, id_col, text_col, pairs=True, bits=hash_bits)


def _joined(gone: DataFrame) -> DataFrame:
    """Chunks to remove, those of a text that overlap or are neighbours joined to one."""
    w = Window.partitionBy("id").orderBy("line", "lines")
    reach = F.max(F.col("line") + F.col("lines")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("opens", F.coalesce(F.col("line") > reach, F.lit(True)).cast("int"))
    gone = gone.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.max(F.col("line") + F.col("lines")) - F.min("line")
    return gone.groupBy("id", "run").agg(F.min("char").alias("char"), F.max("char_end").alias("char_end"), lines.alias("lines"))


def _repeated(docs: DataFrame, id_col: str, text_col: str, pairs: bool, bits: int) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        schema = "id long, n_lines long, n_chunks long, chunks array<struct<start: long, bytes: long, char: long, char_end: long, line: long, lines: long, h: long>>"
        rows = scratch.save(text.mapInArrow(partial(chunk_batches, pairs=pairs, bits=bits), schema), "chunks", keep=True)
        chunks = rows.where("id is not null").select("id", F.inline("chunks"))
        place = F.struct("id", "start")
        # a chunk is named by its hash and length; whether it is equal to the one that stays, its bytes say
        name = ["h", "bytes"]
        groups = chunks.groupBy(*name).agg(F.min(place).alias("first"), F.max(place).alias("latest"), F.count("*").alias("count")).where("first <> latest")
        groups = scratch.save(groups.select(*name, "first", "count"), "groups")
        again = join_groups(chunks, groups, name, "count").where("id <> first.id or start = first.start or start >= first.start + bytes")
        # a chunk of over a thousandth of all is compared in as many parts: fewer than 2000 more copies of what stays
        total = groups.agg(F.sum("count")).first()[0] or 1
        parts = F.ceil(F.col("count") * 1000 / total).cast("int")
        again = scratch.save(again.select("*", (place == F.col("first")).alias("stays"), parts.alias("parts")).drop("first", "count"), "again")
        wanted = again.groupBy("id").agg(F.collect_set(F.struct("start", "bytes", "char", "char_end", "line", "lines", "h", "stays", "parts")).alias("wanted"))
        # of each text only the chunks in question go on
        held = F.expr("transform(wanted, w -> struct(w.char, w.char_end, w.line, w.lines, w.h, w.bytes, w.stays, w.parts, substring(t, cast(w.start as int) + 1, cast(w.bytes as int)) as held))")
        cut = text.where("id is not null").join(wanted, "id").select("id", F.encode("text", "UTF-8").alias("t"), "wanted").select("id", F.inline(held))
        cut = scratch.save(cut, "held")
        kept = cut.where("stays").groupBy(*name).agg(F.min("held").alias("kept"), F.max("parts").alias("parts"))
        kept = scratch.save(kept.select(*name, "kept", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "kept")
        others = cut.where("not stays").withColumn("part", F.pmod(F.xxhash64("id", "char"), F.col("parts")).cast("int"))
        compared = others.join(kept, [*name, "part"]).select("id", "char", "char_end", "line", "lines", "held", (F.col("held") == F.col("kept")).alias("equal"))
        compared = scratch.save(compared.select("id", "char", "char_end", "line", "lines", F.when(~F.col("equal"), F.col("held")).alias("held")).distinct(), "compared")
        gone = compared.where("held is null").drop("held")
        # what only has the hash of the chunk that stays is grouped by its bytes
        apart = compared.where("held is not null")
        least = apart.groupBy("held").agg(F.min(F.struct("id", "char", "char_end")).alias("least"))
        later = apart.join(least, "held").where("id <> least.id or char >= least.char_end").select(*gone.columns)
        gone = gone.union(later)
        gone = _joined(gone) if pairs else gone
        spans = F.transform(F.array_sort(F.collect_list(F.struct("char", "char_end"))), lambda x: F.struct(x["char"].alias("start"), x["char_end"].alias("end")))
        removed = scratch.save(gone.groupBy("id").agg(spans.alias("spans"), F.sum("lines").alias("removed_lines")), "removed", keep=True)
    out = rows.select("id", "n_lines", "n_chunks").join(removed, "id", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))
    return out.select(F.col("id").alias(id_col), "n_lines", "n_chunks", spans.alias("spans"), F.coalesce("removed_lines", F.lit(0).cast("long")).alias("removed_lines"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Per row of docs: its id, ``n_lines``, ``n_chunks`` (overlapping ones, each the start of a search), ``spans`` to remove (characters, end exclusive), ``removed_lines``.

    Of chunks with equal bytes the one with the smallest (id, offset) stays. The
    others go, but for those that overlap it, and with them the line before and
    the line after, where they are those of the one that stays. Each line that is
    removed occurs earlier too. Nothing else removes lines: a run of two lines is
    found unless its hash refuses it (once in 16), a longer one by any of its
    chunks. Spans that overlap or touch are one.

    A null text is empty, which is one empty line. A row without id has no spans
    and none is removed for it. Rows that repeat an id are one document. Chunks
    of one hash that are unequal are told apart by their bytes; ``hash_bits`` is
    for tests of that. Other columns are neither read nor returned. An empty
    table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        rows = scratch.save(text.mapInArrow(partial(run_batches, bits=hash_bits), RUNS), "chunks", keep=True)
        chunks = rows.where("id is not null").select("id", F.inline("chunks")).withColumn("bytes", F.col("end") - F.col("start"))
        place, name = F.struct("id", "start"), ["h", "bytes"]
        groups = chunks.groupBy(*name).agg(F.min(place).alias("first"), F.max(place).alias("latest"), F.count("*").alias("count")).where("first <> latest")
        groups = scratch.save(groups.select(*name, "first", "count"), "groups")
        again = join_groups(chunks, groups, name, "count").where("id <> first.id or start = first.start or start >= first.start + bytes")
        # a chunk of over a thousandth of all is compared in as many parts: fewer than 2000 more copies of what stays
        total = groups.agg(F.sum("count")).first()[0] or 1
        parts = F.ceil(F.col("count") * 1000 / total).cast("int")
        again = scratch.save(again.select("*", (place == F.col("first")).alias("stays"), parts.alias("parts")).drop("first", "count"), "again")
        fields = [c for c in again.columns if c != "id"]
        wanted = again.groupBy("id").agg(F.collect_set(F.struct(*fields)).alias("wanted"))
        # of each text only the chunks in question and their neighbours go on
        piece = lambda a, b: f"substring(t, w.{a} + 1, w.{b} - w.{a})"
        held = F.expr(f"transform(wanted, w -> struct(w.*, {piece('start', 'end')} as held, {piece('left', 'start')} as before, {piece('end', 'right')} as after))".replace("w.*", ", ".join(f"w.{c}" for c in fields)))
        cut = text.where("id is not null").join(wanted, "id").select("id", F.encode("text", "UTF-8").alias("t"), "wanted").select("id", F.inline(held))
        cut = scratch.save(cut, "held")
        kept = cut.where("stays").groupBy(*name).agg(F.min(F.struct("held", "before", "after")).alias("kept"), F.max("parts").alias("parts"))
        kept = scratch.save(kept.select(*name, "kept", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "kept")
        others = cut.where("not stays").withColumn("part", F.pmod(F.xxhash64("id", "start"), F.col("parts")).cast("int"))
        joined = others.join(kept, [*name, "part"]).withColumn("equal", F.col("held") == F.col("kept.held"))
        more = {"start": ("left", F.col("before") == F.col("kept.before")), "end": ("right", F.col("after") == F.col("kept.after"))}

        def edge(kind: str, side: str) -> Column:
            further, same = more[side]
            return F.when(F.col("equal") & same, F.col(f"{kind}_{further}")).otherwise(F.col(f"{kind}_{side}")).cast("long")

        compared = joined.select(
            "id", edge("char", "start").alias("char"), edge("char", "end").alias("char_end"), edge("line", "start").alias("line"),
            (edge("line", "end") - edge("line", "start")).alias("lines"), F.when(~F.col("equal"), F.col("held")).alias("held"),
        )
        compared = scratch.save(compared.distinct(), "compared")
        gone = compared.where("held is null").drop("held")
        # what only has the hash of the chunk that stays is grouped by its bytes
        apart = compared.where("held is not null")
        least = apart.groupBy("held").agg(F.min(F.struct("id", "char", "char_end")).alias("least"), F.count("*").alias("count"))
        least = scratch.save(least.where("count > 1"), "apart")
        later = join_groups(apart, least, ["held"], "count").where("id <> least.id or char >= least.char_end").select(*gone.columns)
        spans = F.transform(F.array_sort(F.collect_list(F.struct("char", "char_end"))), lambda x: F.struct(x["char"].alias("start"), x["char_end"].alias("end")))
        removed = scratch.save(_joined(gone.union(later)).groupBy("id").agg(spans.alias("spans"), F.sum("lines").alias("removed_lines")), "removed", keep=True)
    # rows without id stay out of the join
    named = rows.where("id is not null").select("id", "n_lines", "n_chunks").join(removed, "id", "left")
    out = named.unionByName(rows.where("id is null").select("id", "n_lines", "n_chunks"), allowMissingColumns=True)
    spans = F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))
    return out.select(F.col("id").alias(id_col), "n_lines", "n_chunks", spans.alias("spans"), F.coalesce("removed_lines", F.lit(0).cast("long")).alias("removed_lines"))
