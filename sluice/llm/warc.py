"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The writer makes one gzip member of each record, in archives of bounded size in a folder that driver and executors share.
Each task names its archives anew and hands their names on only when they are complete, so that what a lost or repeated
task left behind is never read.  Payloads that occur more than once are stored once, as the response of the largest page
id; the other pages are revisit records that refer to it.

The reader checks each record: the gzip checksum, the version line, the lengths and the payload digest.  After a failed
check it searches for the next valid gzip member or, in uncompressed archives, the next version line, goes on from there,
and reports the bytes between as quarantined.

Defined cases: a null html or url is empty; very long payloads are one record each; pages that share the largest id of a payload
are all responses; a page without an id is written as `urn:page:none`, read back as null, and a revisit where its payload has a
page with an id (else a response); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import file_system, fresh_dir, materialise, slices

ARCHIVE_BYTES = 32 << 20
_MAGIC, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
RECORDS = "archive string, at long, size long, type string, record_id string, target string, refers_to string, payload binary, payload_bytes long, payload_digest string, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response with the payload, or a revisit whose HTTP header keeps the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place of data and its size; ValueError names the failed check.

    The payload is the block, or where that is an HTTP message (as its type tells) what follows the message's header."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header not ended")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not (head.get("warc-type") and head.get("warc-record-id")):
        raise ValueError("no type or record id")
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    block = data[end + 4 : end + 4 + length]
    if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
        raise ValueError("block cut short")
    http, payload = b"", block
    if head.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)content-length: (\d+)", http)
    size = int(told[1]) if told else len(payload)
    sum_ = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-type") == "response" and (len(payload) != size or sum_ and digest(payload) != sum_):
        raise ValueError("payload does not match its length or digest")
    strip = lambda x: x.strip("<>") if x else None
    return {
        "type": head.get("warc-type"),
        "record_id": strip(head.get("warc-record-id")),
        "target": head.get("warc-target-uri"),
        "refers_to": strip(head.get("warc-refers-to")),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": sum_,
    }, end + 8 + length - at


def _inflate(source, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The gzip member at a place and where it ends; ValueError if it is damaged or cut short."""
    unpacker, out = zlib.decompressobj(31), []
    source.seek(at)
    while not unpacker.eof:
        chunk = source.read(step)
        if not chunk:
            raise ValueError("gzip member cut short")
        at += len(chunk)
        try:
            out.append(unpacker.decompress(chunk))
        except zlib.error as e:
            raise ValueError(f"gzip member: {e}") from None
    return b"".join(out), at - len(unpacker.unused_data)


def _members(data: bytes) -> tuple[list[dict], str | None]:
    """The records of an unpacked member, and the first failed check among them."""
    out, problem, at = [], None, 0
    while at < len(data):
        try:
            found, used = parse(data, at)
            out.append(found)
            at += used
        except ValueError as e:
            problem = problem or str(e)
            at = data.find(b"WARC/1.", at + 1)
            if at < 0:
                break
    return out, problem


def _seek(source, at: int, marks: tuple[bytes, ...], size: int, step: int = 1 << 16) -> int:
    """The next place from `at` on where one of the marks stands; the archive's size if there is none."""
    overlap = max(map(len, marks)) - 1
    while at < size:
        source.seek(at)
        chunk = source.read(step + overlap)
        found = [i for m in marks if (i := chunk.find(m)) >= 0]
        if found:
            return at + min(found)
        at += step
    return size


def read_archive(source, size: int) -> Iterator[dict]:
    """Records of an open archive, compressed or not, each with at, size and problem None; gaps have a problem instead.

    The records of a member that holds several all have its place and size.  If one of those is damaged, the reader goes on
    at the member's next version line and reports the member as a gap besides."""
    at, gap, why = 0, None, ""
    while at < size:
        source.seek(at)
        packed = source.read(3) == _MAGIC
        try:
            if packed:
                data, end = _inflate(source, at)
                records, problem = _members(data)
                if not records:
                    raise ValueError(problem or "empty member")
            else:
                data, end = b"", at
                need = 1 << 16
                while True:  # as much as the record needs, and no more than doubles of it
                    source.seek(at)
                    data = source.read(need)
                    try:
                        found, used = parse(data)
                        break
                    except ValueError:
                        if len(data) < need or not _VERSION.match(data):
                            raise
                        need *= 4
                end, records, problem = at + used, [found], None
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = _seek(source, at + 1, (_MAGIC, b"WARC/1."), size)
            continue
        if gap is not None:
            yield {"at": gap, "size": at - gap, "problem": why}
            gap = None
        for found in records:
            yield found | {"at": at, "size": end - at, "problem": None}
        if problem:
            yield {"at": at, "size": end - at, "problem": f"in a member: {problem}"}
        at = end
    if gap is not None:
        yield {"at": gap, "size": size - gap, "problem": why}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """A table of (archive, records) of what was written; pages: page_id, url, html, refers_to (null: response)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, names, held = None, [], 0
        for batch in batches:
            for part in slices(batch, "html"):
                for row in part.to_pylist():
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, held, count = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    kind = "response" if row["response"] else "revisit"
                    data = member(record(kind, _urn(row["page_id"]), row["url"] or "", row["html"].encode(), _urn(row["refers_to"])))
                    out.write(data)
                    held, count = held + len(data), count + 1
                    if held >= ARCHIVE_BYTES:
                        out.close()
                        names.append((f"{folder}/{name}", count))
                        out = None
        if out is not None:
            out.close()
            names.append((f"{folder}/{name}", count))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in names], t) for i, t in ((0, pa.string()), (1, pa.int64()))], names=["archive", "records"])

    return materialise(pages.mapInArrow(run, "archive string, records long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (problem is not null) of archives, one row each; archive names in column archive."""
    schema = RECORDS if payloads else RECORDS.replace("payload binary, ", "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                system, path = file_system(name)
                with system.open_input_file(path) as source:
                    rows, held = [], 0
                    for found in read_archive(source, source.size()):
                        rows.append({"archive": name} | found)
                        held += len(found.get("payload") or b"") if payloads else 200
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    return archives.select("archive").mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives of the shared folder; the table of the archives."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # of a payload that occurs once nothing need be known; a hot payload is one row here, and its join can be split
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    marked = rows.join(groups.select("digest", "first"), "digest", "left")
    response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return write_archives(marked.select("page_id", "url", "html", response.alias("response"), F.col("first").alias("refers_to")), fresh_dir(spark, "warc"))
