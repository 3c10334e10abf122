"""WARC archives as Spark tables: writing with segments, and reassembly on reading.

A record is text whose lines Spark's text writer ends, so archives are written
and read by Spark alone, in any of its stores, one gzip file per task; payloads
are UTF-8, and a file is one gzip member. Reading streams the lines of each file
once through a parser that holds one record at a time. Large records are cut into
segments; they are put together again by grouping continuation records by the
identifier of their origin, ordering by segment number, verifying the total
length and decoding the chunked transfer framing. Whole records are decoded where
they are read, so that only segments' blocks are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphmill.llm._shared import Scratch, shared_dir

VERSION = "WARC/1.1"
#: Bytes of a record's block in one segment, and of a transfer chunk.
SEGMENT_BYTES, CHUNK_BYTES = 256 * 1024, 16 * 1024
#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
PARSED = "record_id string, type string, page_id long, uri string, origin string, segment int, total long, length long, digest string, refers_to long, block binary, fault boolean"


# ---- writing ------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size line")
        at += 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r"


def _segments(record_id: str, page: int | None, uri: str, block: bytes, digest: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A response record, cut into segments if its block is large; cuts fall between characters."""
    cuts, at = [0], 0
    while len(block) - at > segment_bytes:
        at += segment_bytes
        while block[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    cuts.append(len(block))
    for i in range(len(cuts) - 1):
        own = [("WARC-Type", "response" if i == 0 else "continuation"), ("WARC-Record-ID", f"{record_id}#{i + 1}" if i else record_id)]
        own += [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("X-Page-ID", "" if page is None else page)]
        if i == 0:
            own += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
        else:
            own += [("WARC-Segment-Origin-ID", record_id)]
        if len(cuts) > 2:
            own += [("WARC-Segment-Number", i + 1)]
            if i == len(cuts) - 2:
                own += [("WARC-Segment-Total-Length", len(block))]
        yield _record(own, block[cuts[i] : cuts[i + 1]])


def _written(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of pages to the text of their records."""
        for batch in batches:
            records: list[str] = []
            size = 0
            for row, page, uri, digest, refers, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                record_id = f"<urn:row:{row}>"
                uri = "".join((uri or "").split())
                if refers is not None:
                    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("X-Page-ID", "" if page is None else page)]
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Refers-To-Page-ID", refers)]
                    own = [_record(headers, b"").decode()]
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked_text(payload or "", chunk_bytes)
                    own = [r.decode() for r in _segments(record_id, page, uri, block, digest, segment_bytes)]
                records += own
                size += sum(map(len, own))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])
                    records, size = [], 0
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])

    return run


def chunked_text(payload: str, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """Chunked framing whose chunks end between characters, so that the text writer can hold it."""
    data, parts, at = payload.encode(), [], 0
    while at < len(data):
        end = min(at + chunk_bytes, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(b"%x\r\n%s\r\n" % (end - at, data[at:end]))
        at = end
    return b"".join(parts) + b"0\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record per row of pages under ``path``, as gzip files.

    Of rows with equal payloads of ``REVISIT_BYTES`` at least, that with the
    largest id is a response and the others revisit it; rows that repeat its id
    are responses too, and rows without id are revisits unless none has one.
    Records of more than ``segment_bytes`` are cut into segments (8 bytes at
    least), payloads into chunks of ``chunk_bytes`` (4 at least).
    """
    if segment_bytes < 8 or chunk_bytes < 4:
        raise ValueError("segments of 8 bytes and chunks of 4 are the smallest")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # equal payloads: by SHA-256 and length; SHA-1 is only what the record says. A small payload has a key of its own.
    same = F.when(large, F.concat_ws(":", F.sha2(F.col("payload").cast("binary"), 256), F.octet_length("payload"))).otherwise(F.concat(F.lit("row:"), F.col("row")))
    rows = rows.withColumn("same", same)
    with Scratch(pages.sparkSession) as scratch:
        first = rows.where(large).groupBy("same").agg(F.max("page").alias("winner"), F.count("*").alias("held")).where("held > 1")
        # saved, so that Spark knows its size, and can split a join that it doesn't broadcast
        first = scratch.save(first, "winners")
        joined = rows.join(first, "same", "left")
        refers = F.when(F.col("winner").isNotNull() & ~F.col("page").eqNullSafe(F.col("winner")), F.col("winner"))
        text = F.when(refers.isNull(), F.col("payload"))
        out = joined.select("row", "page", "uri", "sha1", refers.alias("refers"), text.alias("payload"))
        out.mapInArrow(_written(segment_bytes, chunk_bytes), "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)


# ---- reading ------------------------------------------------------------------------------------


class _Parser:
    """Lines of one archive, in order, to records; a line comes without its newline.

    A record whose length isn't a number, or that the file's end cuts off, is a
    record with a fault and an empty block.
    """

    def __init__(self) -> None:
        self.head: list[bytes] | None = None
        self.need, self.block, self.fields = -1, [], {}

    def line(self, line: bytes) -> dict | None:
        if self.need < 0:
            line = line.rstrip(b"\r")
            if self.head is None:
                if line.startswith(b"WARC/"):
                    self.head = []
                return None
            if line:
                self.head.append(line)
                return None
            self._read_head()
            length = self.fields.get("content-length") or ""
            if not (length.isascii() and length.isdigit()):
                return self._done(fault=True)
            self.need = int(length)
            return self._done() if self.need == 0 else None
        line += b"\n"
        self.block.append(line[: self.need])
        self.need -= len(self.block[-1])
        return self._done() if self.need == 0 else None

    def end(self) -> dict | None:
        """The record that the end of the file cuts off, if there is one."""
        if self.head is not None:
            self._read_head()
        elif self.need < 0:
            return None
        return self._done(fault=True)

    def _read_head(self) -> None:
        self.fields = {}
        for h in self.head:
            k, _, v = h.partition(b":")
            self.fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        self.head, self.block = None, []

    def _done(self, fault: bool = False) -> dict:
        self.need = -1
        return {"fields": self.fields, "block": b"" if fault else b"".join(self.block), "fault": fault}


def _number(text: str | None) -> int | None:
    """A number that a long holds, else nothing."""
    return int(text) if text and text.isascii() and text.lstrip("-").isdigit() and len(text) <= 18 else None


def _row(found: dict, place: str) -> dict:
    """A record's row; one without an identifier is named by its place."""
    f, block = found["fields"], found["block"]
    own = f.get("warc-record-id") or place
    segment = f.get("warc-segment-number")
    number = _number(segment)
    wrong = found["fault"] or (segment is not None and (number is None or not 0 < number < 1 << 31))
    return {
        "record_id": own, "type": f.get("warc-type"), "page_id": _number(f.get("x-page-id")), "uri": f.get("warc-target-uri"), "origin": f.get("warc-segment-origin-id") or own,
        "segment": None if wrong else number, "total": _number(f.get("warc-segment-total-length")), "length": len(block),
        "digest": (f.get("warc-payload-digest") or "").removeprefix("sha1:"), "refers_to": _number(f.get("x-refers-to-page-id")), "block": block, "fault": wrong,
    }


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, line) to records; the lines of a file come in order and from one task."""
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in PARSED.split(", "))])
    now, parser, n = None, _Parser(), 0
    for batch in batches:
        rows, size = [], 0
        for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ready = []
            if file != now:
                ready.append((parser.end(), now))
                now, parser = file, _Parser()
            ready.append((parser.line(line), now))
            for found, where in ready:
                if found is not None:
                    n += 1
                    rows.append(_row(found, f"{where}#{n}"))
                    size += len(found["block"])
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if (found := parser.end()) is not None:
        yield pa.RecordBatch.from_pylist([_row(found, f"{now}#{n + 1}")], schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records, segments each, of all gzip archives under path; ``fault`` marks those that aren't whole.

    Only ``*.gz`` files are read: Spark cuts none of them, so a file's lines come in order.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(_parsed, PARSED)


def _payload(block: bytes, digest: str) -> tuple[int | None, str | None, bool]:
    """Of a whole HTTP response: its payload's length and digest, and whether it isn't what its record says."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in head.lower():
        try:
            body = dechunked(body)
        except ValueError:
            return None, None, True
    sha1 = hashlib.sha1(body).hexdigest()
    return (len(body), sha1, False) if sha1 == digest else (None, None, True)


WHOLE = "origin string, type string, page_id long, refers_to long, digest string, segment int, total long, length long, block binary, payload_bytes long, fault boolean"


def _decoded_where_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, with whole responses decoded; only segments keep their blocks."""
    for batch in batches:
        columns = {c: batch.column(c) for c in ("origin", "type", "page_id", "refers_to", "digest", "segment", "total", "length", "block", "fault")}
        kinds, segments, digests, given, wrong = (columns[c].to_pylist() for c in ("type", "segment", "digest", "block", "fault"))
        blocks, lengths, faults = [], [], []
        for kind, segment, digest, block, fault in zip(kinds, segments, digests, given, wrong, strict=True):
            length = None
            if kind == "response" and segment is None and not fault:
                length, _, fault = _payload(block, digest)
            blocks.append(block if segment is not None else None)
            lengths.append(length)
            faults.append(bool(fault))
        columns |= {"block": pa.array(blocks, pa.binary()), "payload_bytes": pa.array(lengths, pa.int64()), "fault": pa.array(faults, pa.bool_())}
        names = [x.split()[0] for x in WHOLE.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of segments, in order, put together to their payload's length, and whether they are as their record says."""
    for batch in batches:
        lengths, faults, blocks = [], [], batch.column("blocks")
        # a record's segments lie next to each other in the batch: together they are its block
        own, data = blocks.offsets.to_numpy(), blocks.values.buffers()[2]
        ends = np.frombuffer(blocks.values.buffers()[1], np.int32)[blocks.values.offset :] if len(blocks.values) else np.zeros(1, np.int32)
        places = ends[own].tolist()
        whole = zip(blocks.is_valid().to_pylist(), places[:-1], places[1:], strict=True)
        for (there, a, b), digest, length, fault in zip(whole, *(batch.column(c).to_pylist() for c in ("digest", "payload_bytes", "fault")), strict=True):
            if there and not fault:
                length, _, fault = _payload(data[a:b].to_pybytes() if b > a else b"", digest)
            lengths.append(None if fault else length)
            faults.append(fault)
        columns = [batch.column(c) for c in ("page_id", "record_id", "type", "digest", "refers_to")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64()), pa.array(faults, pa.bool_())], ["page_id", "record_id", "type", "digest", "refers_to", "payload_bytes", "fault"])


def reassembled(records: DataFrame) -> DataFrame:
    """Responses and revisits by their origin: ``page_id``, ``record_id``, ``type``, ``digest``, ``refers_to``, ``payload_bytes``, ``fault``.

    Records are grouped by origin. A response has a fault if it or a segment is
    broken, if its segments are not 1..n, if their length is not the total that
    the last one states, or if its framing or digest is wrong; then its length is
    null. Continuations without a first segment are a response with a fault and
    no page. Records of other types are left out. A group is one record's
    segments; records that repeat an identifier are one, with a fault.
    """
    known = records.where("type in ('response', 'continuation', 'revisit') or fault")
    slim = known.mapInArrow(_decoded_where_whole, WHOLE)
    first = F.when(F.coalesce(F.col("segment"), F.lit(1)) == 1, F.struct("page_id", "digest", "type", "refers_to", "payload_bytes"))
    parts = slim.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("parts"),
        F.sum(F.when(F.col("segment").isNotNull(), F.col("length"))).alias("length"), F.count("*").alias("n"),
        F.max("segment").alias("last"), F.max("total").alias("total"), F.max(first).alias("first"), F.max("fault").alias("fault"),
    )
    # each byte is copied once, when a task joins a record's segments
    whole = F.transform("parts", lambda x: x["block"])
    segmented = F.size("parts") > 0
    numbered = (F.col("n") == F.col("last")) & F.expr("size(array_distinct(transform(parts, x -> x.segment))) = n") & F.col("length").eqNullSafe(F.col("total"))
    right = F.col("first").isNotNull() & F.when(segmented, numbered).otherwise(F.col("n") == 1)
    many = parts.select(
        F.col("first.page_id").alias("page_id"), F.col("origin").alias("record_id"), F.coalesce("first.type", F.lit("response")).alias("type"), F.col("first.digest").alias("digest"), F.col("first.refers_to").alias("refers_to"),
        F.when(segmented & right, whole).alias("blocks"), F.col("first.payload_bytes").alias("payload_bytes"), (F.col("fault") | ~right).alias("fault"),
    )
    return many.mapInArrow(_decoded, "page_id long, record_id string, type string, digest string, refers_to long, payload_bytes long, fault boolean")


def archived_pages(records: DataFrame) -> DataFrame:
    """Per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``fault``; a revisit's payload is that of its response.

    A response with a fault has a null length and digest; a revisit without a
    right response keeps the digest it states and has a fault and a null length.
    The records are read once, and what is kept of each is small.
    """
    spark = records.sparkSession
    with Scratch(spark) as scratch:
        found = scratch.save(reassembled(records), "records", keep=True)
        slim = found.where("type = 'response' and not fault").groupBy("page_id", "digest").agg(F.max("payload_bytes").alias("held_bytes")).withColumnRenamed("page_id", "refers_to")
        slim = scratch.save(slim, "responses", keep=True)
    responses = found.where("type = 'response'")
    out = responses.select("page_id", "payload_bytes", F.when(~F.col("fault"), F.col("digest")).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "fault")
    again = found.where("type = 'revisit'").select("page_id", "digest", "refers_to", "fault").join(slim, ["refers_to", "digest"], "left")
    lost = F.col("fault") | F.col("held_bytes").isNull()
    return out.union(again.select("page_id", F.when(~lost, F.col("held_bytes")), F.col("digest"), F.lit("revisit"), "refers_to", lost))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record per row of pages to the shared folder, read the archives and return what they hold per row.

    A null payload is empty. A null id is read back as null. Repeated rows have a
    record each. White space in URLs is left out; a null URL is empty. Other
    columns are neither read nor returned. An empty table gives an empty result.
    ``fault`` is true for a record that is not read back as its header says; its
    length and digest are null.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        path = shared_dir(spark, "warc")
        scratch.paths.append(path)
        write_archives(pages, path, id_col, url_col, payload_col, segment_bytes, chunk_bytes)
        found = archived_pages(read_archives(spark, path))
    return found.withColumnRenamed("page_id", id_col)
