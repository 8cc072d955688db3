"""WARC: archives with segmented records and chunked payloads, written and read back with their segments put together again.

An archive is a row (part, seq, content) of a written table, so any store that Spark writes to can hold archives and a lost executor leaves no half of one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import id_type, written

#: Block bytes of one segment, bytes of one chunk of the transfer coding, bytes after which a new archive begins.
SEGMENT = 8192
CHUNK = 4096
ARCHIVE = 4 << 20
#: Names and the date of records.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def bare_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in HTTP's chunked transfer coding."""
    out = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in fields.items() if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = {}
        for line in lines:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        at = end + 4 + n + 4
        if content[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, content[end + 4 : end + 4 + n]


def response_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def segments(fields: dict[str, object], block: bytes, most: int) -> Iterator[bytes]:
    """The record, or if its block is larger than ``most`` its first segment and the continuations."""
    if len(block) <= most:
        yield record(fields, block)
        return
    origin, pieces = fields["WARC-Record-ID"], [block[a : a + most] for a in range(0, len(block), most)]
    yield record(fields | {"WARC-Segment-Number": 1}, pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        more = {"WARC-Segment-Total-Length": len(block)} if k == len(pieces) else {}
        head = {
            "WARC-Type": "continuation", "WARC-Record-ID": f"<{uuid.uuid5(SPACE, f'{origin} {k}').urn}>", "WARC-Date": DATE, "WARC-Target-URI": fields["WARC-Target-URI"],
            "WARC-Segment-Number": k, "WARC-Segment-Origin-ID": origin,
        }
        yield record(head | more, piece)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first, first_url: ``first`` is the smallest page_id with the same payload where that is another one, else null.

    Digests are grouped with partial sums and only payloads that occur again are written, so that Spark knows their table's size: a small one is broadcast, and the pages aren't shuffled at
    all; beside a large one, a payload that a third of all pages have is split over tasks by adaptive execution.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = base.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(named).alias("least")).where("n > 1")
    groups = groups.select("digest", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"))
    out = base.join(written(groups, "warc-groups"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes)
    return out.select("page_id", "url", "html", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))


def write_warc(pages: DataFrame, least_bytes: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html): the table (part, seq, content) of archives.

    The smallest page_id of equal payloads is a response, others are revisits of it; rows that share that id are responses too. Null html: empty payload.
    A null page_id is left out of its record and never revisited. The other columns don't matter; an empty table gives no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, n, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "content": [b"".join(held)]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("content", pa.binary())]))

        for batch in batches:
            for page, url, html, first, first_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "first_url")), strict=True):
                payload = html.encode()
                n += 1
                fields = {
                    "WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": f"<{uuid.uuid5(SPACE, f'{part} {n} {page}').urn}>", "WARC-Date": DATE,
                    "WARC-Target-URI": url or "urn:none", "WARC-Payload-Digest": f"sha1:{bare_digest(payload)}", "Page-Id": page, "Payload-Length": len(payload), "Content-Type": "application/http; msgtype=response",
                }
                if first is None:
                    pieces = segments(fields, response_block(payload), segment)
                else:
                    again = {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": first_url or "urn:none", "WARC-Refers-To-Date": DATE, "Page-Refers-To": first}
                    pieces = [record(fields | again, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")]
                for piece in pieces:
                    if not held or size > archive:
                        if held:
                            yield put()
                            seq += 1
                        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{uuid.uuid5(SPACE, f'{part} info {seq}').urn}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
                        held, size = [record(info, b"format: WARC File Format 1.1\r\n")], 0
                    held.append(piece)
                    size += len(piece)
        if held:
            yield put()

    rows = deduplicated(pages.select("page_id", "url", "html"), least_bytes)
    return written(rows.mapInArrow(run, "part int, seq int, content binary"), "warc")


_PARSED = "origin string, segment int, total long, page_id {id}, url string, record_type string, digest string, length long, refers_to {id}, block binary"
_READ = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary, error string"


def read_warc(archives: DataFrame, page_id: str = "long") -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, error of each response and revisit record.

    Continuations are grouped by the record they go on from and ordered by their numbers; the numbers must run from 1 without gaps, the last must
    give the total length, and the payload's digest must be the header's, else ``error`` says what is wrong (null if nothing is). A
    revisit's payload is null. An archive that is damaged gives the records before the damage and a row with nothing but ``error``. A null
    or empty archive gives no rows. Only segmented records are shuffled.
    """
    parsed, read = _PARSED.format(id=page_id), _READ.format(id=page_id)
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if page_id not in kinds:
        raise TypeError(f"page ids are whole numbers or texts, not {page_id}")
    kind = kinds[page_id]
    value = str if page_id == "string" else int
    fields = [
        ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()),
        ("length", pa.int64()), ("refers_to", kind), ("block", pa.binary()),
    ]

    def rows(split: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content").to_pylist():
                    out = []
                    try:
                        for row in parsed_rows(content or b""):
                            out.append(row)
                    except (ValueError, KeyError) as e:
                        if not split:
                            out.append((None, None, None, None, None, "damaged", None, None, None, f"a damaged archive: {e}".encode()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

        def parsed_rows(content: bytes) -> Iterator[tuple]:
            for h, block in records(content):
                kind = h.get("warc-type")
                if kind not in ("response", "revisit", "continuation") or ("warc-segment-number" in h) != split:
                    continue
                number = lambda name, h=h, f=int: f(h[name]) if name in h else None
                yield (
                    h.get("warc-segment-origin-id", h["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"), number("page-id", f=value),
                    h.get("warc-target-uri"), kind, h.get("warc-payload-digest"), number("payload-length"), number("page-refers-to", f=value), block,
                )

        return archives.select("content").mapInArrow(run, parsed)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in read.split(", ")]
        types = [kind, pa.string(), pa.string(), kind, pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "digest", "length", "refers_to", "total", "pieces")]
            for page, url, what, digest, length, refers, total, pieces in zip(*columns, strict=True):
                if what == "damaged":
                    out.append((page, url, None, None, None, None, None, pieces[0]["block"].decode()))
                    continue
                bare = (digest or "").removeprefix("sha1:")
                if what == "revisit":
                    out.append((page, url, what, refers, length, bare, None, None))
                    continue
                payload = error = None
                block = b"".join(p["block"] for p in pieces)
                numbers = [p["segment"] for p in pieces]
                if what is None:
                    error = "the first segment is missing"
                elif numbers != [None] and numbers != list(range(1, len(numbers) + 1)):
                    error = "segments are missing or repeat"
                elif numbers != [None] and total != len(block):
                    error = "the total length differs"
                else:
                    try:
                        payload = payload_of(block)
                        if digest and bare_digest(payload) != bare:
                            error = "the payload digest differs"
                    except ValueError as e:
                        error = str(e)
                out.append((page, url, what, refers, None if payload is None else len(payload), None if payload is None else bare_digest(payload), payload, error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    piece = F.struct("segment", "block")
    own = F.col("record_type") != "continuation"
    whole = rows(False).select("page_id", "url", "record_type", "digest", "length", "refers_to", "total", F.array(piece).alias("pieces"))
    first = [F.max(F.when(own, F.col(c))).alias(c) for c in ("page_id", "url", "record_type", "digest", "length", "refers_to")]
    joined = rows(True).groupBy("origin").agg(*first, F.max("total").alias("total"), F.sort_array(F.collect_list(piece)).alias("pieces")).drop("origin")
    return whole.unionByName(joined).mapInArrow(finish, read)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes and reads back: one row for each row of ``pages``, as ``read_warc`` gives it."""
    return read_warc(write_warc(pages, least_bytes), id_type(pages, "page_id"))
