"""WARC archives: writing with chunked transfer framing, segments and revisits, and reading back.

A response record's block is an HTTP response in chunked framing, cut into segments where it is long:
the first is the record, the others are continuation records that name it as their origin. Reading
groups continuations by origin, orders them by segment number, verifies the total length, and takes
the framing off. Every record is a gzip member of its own, as is usual, so that readers can start at
any of them. Files are written and read by Spark, so that any store will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.llm.common import mapped, materialised, scratch_path

CHUNK, SEGMENT, RECORDS_PER_FILE = 2048, 4096, 4096
#: Bytes that a task holds before it gives rows out, about, and bytes inflated at a time.
HELD, PIECE = 2 << 20, 1 << 18
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, without padding (20 bytes need none)."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0" + END


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode() + END + block + END


def member(record: bytes) -> bytes:
    """A record as a gzip member."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _header_value(text: str | None) -> str | None:
    """A URL without line ends, which would break the header."""
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, unique: str, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one page. refers_to: (page_id, url) of the response that a revisit stands for."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, unique)}>"
    digest = f"sha1:{payload_digest(payload)}"
    shared = [("WARC-Target-URI", _header_value(url)), ("WARC-Date", DATE), ("WARC-Page-ID", page_id)]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to:
        block = (head + f"Content-Length: {len(payload)}").encode() + END
        fields = [("WARC-Record-ID", name), *shared, ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE)]
        fields += [("WARC-Refers-To-Target-URI", _header_value(refers_to[1])), ("WARC-Refers-To-Page-ID", refers_to[0])]
        yield _record("revisit", fields, block)
        return
    block = (head + "Transfer-Encoding: chunked").encode() + END + chunked(payload, chunk)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    several = len(parts) > 1
    yield _record("response", [("WARC-Record-ID", name), *shared, ("WARC-Payload-Digest", digest), ("WARC-Segment-Number", 1 if several else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{unique}#{k}')}>"
        total = len(block) if k == len(parts) else None
        fields = [("WARC-Record-ID", own), *shared, ("WARC-Segment-Number", k), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Total-Length", total)]
        yield _record("continuation", fields, part)


def inflated(data: bytes | memoryview, piece: int = PIECE) -> Iterator[bytes]:
    """The content of an archive in pieces: all gzip members one after the other, or what isn't compressed as it is.

    ValueError if the last member is cut short. Zero bytes between members are passed over.
    """
    at, data = 0, memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[k : k + piece]) for k in range(0, len(data), piece))
        return
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        one, rest = zlib.decompressobj(31), b""
        while not one.eof:
            if not rest:
                rest, at = bytes(data[at : at + piece]), min(at + piece, len(data))
                if not rest:
                    raise ValueError("the archive ends inside a gzip member")
            try:
                out = one.decompress(rest, piece)
            except zlib.error as error:
                raise ValueError(f"no gzip member before byte {at}") from error
            rest = one.unconsumed_tail
            if out:
                yield out
        at -= len(one.unused_data)


def header(lines: list[bytes]) -> dict[str, str]:
    """Fields by lower-case name: blanks around a value go, folded lines are joined, of a name's values the last counts."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, _, value = line.partition(b":")
        name = key.strip().decode("utf-8", "replace").lower()
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive given in pieces; ValueError if it is cut short or holds something else."""
    held, at, source = bytearray(), 0, iter(pieces)

    def more() -> None:
        nonlocal held, at
        if at:
            del held[:at]
            at = 0
        found = next(source, None)
        if found is None:
            raise ValueError("the archive ends inside a record")
        held += found

    while True:
        while held.startswith(b"\r\n", at):  # a line end too many
            at += 2
        if at >= len(held):
            try:
                more()
            except ValueError:
                return
            continue
        looked = at
        while (end := held.find(END, looked)) < 0:
            far = len(held) - at
            more()
            looked = max(0, far - 3)
        lines = bytes(held[at:end]).split(b"\r\n")
        fields = header(lines[1:])
        if not lines[0].startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        size, skip = int(fields["content-length"]), end + 4 - at
        while len(held) - at < skip + size + 4:
            more()
        low = at + skip
        if bytes(held[low + size : low + size + 4]) != END:
            raise ValueError("a record does not end where it should")
        yield fields, bytes(held[low : low + size])
        at = low + size + 4


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Archives of pages (page_id, url, html) below path; other columns are not looked at.

    Of pages whose payload, html in UTF-8, is equal and has min_bytes at least, that with the smallest
    page_id is written as response and the others as revisits of it; rows that repeat the smallest
    page_id are responses as well. Null html is an empty payload. A null page_id counts as larger than
    any and is never referred to, so that equal pages that all lack an id are responses. Payloads that
    occur once never meet in a shuffle with their text, nor do others if the table of repeated
    payloads is small.
    """
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = named.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = keyed.filter(F.octet_length("html") >= min_bytes) if min_bytes else keyed
    first = large.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    first = materialised(first.filter("n > 1 AND first_id IS NOT NULL").select(F.col("sha").alias("first_sha"), "first_id", "first_url"), "repeated")
    joined = keyed.join(first, keyed["sha"] == first["first_sha"], "left")
    if min_bytes:
        joined = joined.withColumn("first_id", F.when(F.octet_length("html") >= min_bytes, F.col("first_id")))
    rows = joined.select("page_id", "url", F.col("html").cast("binary").alias("payload"), "first_id", "first_url")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        out, size = [], 0
        for batch in source:
            for page_id, url, payload, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k += 1
                revisit = (first_id, first_url) if first_id is not None and first_id != page_id else None
                for record in records(page_id, url, payload, revisit, f"page:{page_id}/{part}/{k}", segment, chunk):
                    # a member ends in its record's size as four bytes, of which the last is 0: the writer sets it, as the line end
                    out.append(member(record)[:-1])
                    size += len(out[-1])
                    if size > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    if segment > 1 << 23:
        raise ValueError("segments of more than 8 MiB cannot be written")
    lines = mapped(rows, batches, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = lines.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(path)


_PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
#: A record on its way: what is found of a whole one, or a segment's number, total length, digest and block.
_RECORD = f"origin string, number int, total long, digest string, block binary, {_PAGE}, payload binary"
_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def response_payload(block: bytes) -> bytes:
    """The body of an HTTP response without its chunked framing; ValueError if that is broken."""
    head, _, body = block.partition(END)
    codings = header(head.split(b"\r\n")[1:]).get("transfer-encoding", "").lower().split(",")
    return unchunked(body) if codings[-1].strip() == "chunked" else body


def _number(text: str | None) -> int | None:
    return int(text) if text and text.strip().lstrip("-").isdigit() else None


def _digest(fields: dict[str, str]) -> str | None:
    """The record's SHA-1 in base 32; digests of another kind count as none."""
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    return value.upper() if kind.lower() == "sha1" and len(value) == 32 else None


def _page(page_id: int | None, url: str | None, digest: str | None, block: bytes) -> tuple:
    """What a whole response gives, its payload last; damaged if the framing is broken or the digest is another."""
    try:
        payload = response_payload(block)
        own = payload_digest(payload)
        if digest in (None, own):
            return page_id, url, len(payload), own, "response", None, True, payload
    except ValueError:
        pass
    return page_id, url, None, None, "response", None, False, None


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact, payload) of each response and revisit.

    The digest of a response is made from the payload read, and intact tells whether it equals the
    record's (if that is a SHA-1), all segments are there, and their total length is that declared; a
    damaged response has a null payload, length and digest. A revisit has the length and digest of its
    record and no payload. Records of other types, and their segments, are passed over. page_id and
    refers_to are fields of this writer: of other archives they are null. Archives may be compressed
    by record, as a whole, or not at all; a cut archive fails the job. A task takes a file's compressed
    bytes and at most a page at a time beside them. Without `payload` that column isn't made.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for content in batch.column(0):
                out, size = [], 0
                for f, block in parsed(inflated(memoryview(content.as_buffer()))):
                    kind, number, own = f.get("warc-type", "").lower(), _number(f.get("warc-segment-number")), f.get("warc-record-id")
                    page_id, url, digest, none = _number(f.get("warc-page-id")), f.get("warc-target-uri"), _digest(f), (None,) * 8
                    if kind == "continuation":
                        row = (f.get("warc-segment-origin-id"), number, _number(f.get("warc-segment-total-length")), None, block, *none)
                    elif number and kind != "response":  # other segments are told apart by their first one
                        row = (own, 1, None, None, None, *none)
                    elif number:
                        row = (own, 1, _number(f.get("warc-segment-total-length")), digest, block, page_id, url, *none[2:])
                    elif kind == "response":
                        found = _page(page_id, url, digest, block)
                        row = (own, 0, None, None, None, *(found if payload else (*found[:-1], None)))
                    elif kind == "revisit":
                        length = _number(header(block.split(END)[0].split(b"\r\n")[1:]).get("content-length"))
                        row = (own, 0, None, None, None, page_id, url, length, digest, kind, _number(f.get("warc-refers-to-page-id")), True, None)
                    else:
                        continue
                    out.append(row)
                    size += len(row[4] or b"") + len(row[-1] or b"") + 200
                    if size > HELD:
                        yield _batch(out, _RECORD)
                        out, size = [], 0
                yield _batch(out, _RECORD)

    return reassembled(mapped(files, rows, _RECORD), payload)


def reassembled(found: DataFrame, payload: bool = True) -> DataFrame:
    """Records as rows to pages: a page's segments meet by origin, in the order of their numbers, and are joined as they come."""
    dealt = found.repartition("origin").sortWithinPartitions("origin", "number")
    ddl = _PAGE + ", payload binary" * payload

    def joined(parts: list[tuple]) -> tuple | None:
        """A page of the segments (number, total, digest, block, page_id, url); None if they are of another record type."""
        first = parts[0]
        if first[0] == 1 and first[3] is None:
            return None
        page_id, url, block = first[4], first[5], b"".join(p[3] or b"" for p in parts)
        if [p[0] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1][1] == len(block):
            return _page(page_id, url, first[2], block)
        return page_id, url, None, None, "response", None, False, None

    def pages(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        origin, parts = None, []

        def close() -> None:
            nonlocal size
            if parts and (page := joined(parts)):
                out.append(page if payload else page[:-1])
                size += 200 + len(page[-1] or b"") * payload

        for batch in source:
            for own, number, total, digest, block, page_id, url, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    out.append((page_id, url, *(rest if payload else rest[:-1])))
                    size += 200 + len(rest[-1] or b"")
                else:
                    if own != origin or own is None:
                        close()
                        origin, parts = own, []
                    parts.append((number, total, digest, block, page_id, url))
                if size > HELD:
                    yield _batch(out, ddl)
                    out, size = [], 0
        close()
        yield _batch(out, ddl)

    return mapped(dealt, pages, ddl)


def round_trip(pages: DataFrame, min_bytes: int = 0, payload: bool = True) -> DataFrame:
    """pages written as archives in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path, payload)
