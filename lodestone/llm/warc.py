"""WARC archives on shared storage: a writer, and a reader that salvages what damage leaves.

Writer: equal payloads of at least ``least`` bytes are stored once, as a response under the smallest id; the others become
revisit records that refer to it. Groups are found by digest with combining aggregates, so a payload that very many pages
share moves as one row a task. Records are gzip members of their own, written by Spark's text sink; an empty member is the
"line" separator, which every gzip reader skips. A file has at most ``FILE_RECORDS`` records.

Reader: each file is read record by record, with or without compression. A record counts if its member inflates and passes
gzip's checksum, its version line, header and length are whole, and its payload digest holds. Otherwise the reader looks for
the next gzip header whose member starts with a version line, or the next version line, goes on from there, and reports the
bytes between as a quarantined gap.

Defined results: null html is empty; a null url is written as ``urn:page:`` and the id; a null id ranks after all others and
is read back as null; rows that repeat id and payload of a response are responses too; empty tables write no records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import shared_path, written

LEAST = 100
FILE_RECORDS = 10_000  #: records of an archive at most, as a reader takes whole files
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\r(?!\n)")
_MEMBER = b"\x1f\x8b\x08"
PIECE = 1 << 16


def record(kind: str, page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a response's block is an HTTP message, a revisit's its header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body if kind == "response" else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, file_records: int = FILE_RECORDS) -> None:
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    shared = rows.where(F.octet_length("body") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(k, 256).to_pylist():
                    again = r["first"] is not None and r["id"] != r["first"]
                    data = r["body"].encode()
                    out.append(gzip.compress(record("revisit" if again else "response", r["id"], r["url"], data, r["digest"], r["first"]), 6, mtime=0))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members_of = rows.join(shared, "digest", "left").select("id", "url", "body", "digest", "first").mapInArrow(members, "member binary")
    separator = EMPTY_MEMBER.decode("latin-1")
    members_of.select(F.col("member").cast("string").alias("value")).write.option("maxRecordsPerFile", file_records).option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _checked(data: bytes) -> tuple[dict[str, str], bytes] | str:
    """Header and block of a record that fills ``data``, or what is wrong with it."""
    if not _VERSION.match(data):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "header without end"
    if _CONTROL.search(data, 0, end):
        return "control characters in the header"
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without colon"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        return "no length"
    size = int(head["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        return "length does not fit"
    if head.get("warc-type") == "response" and head.get("warc-payload-digest", "").startswith("sha256:"):
        if hashlib.sha256(payload(block)).hexdigest() != head["warc-payload-digest"][7:]:
            return "digest differs"
    return head, block


def payload(block: bytes) -> bytes:
    """The body of an HTTP message."""
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if block.startswith(b"HTTP/") and at >= 0 else block


def _inflate(view: memoryview, at: int, most: int | None = None) -> tuple[bytes, int] | str:
    """A gzip member's content and its end; or why it fails. With ``most``, the content's first bytes will do."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(view):
            out.append(d.decompress(view[pos : pos + PIECE], most or 0))
            pos += PIECE
            if most and out[-1]:
                return out[-1], pos
    except zlib.error as e:
        return str(e)
    return (b"".join(out), min(pos, len(view)) - len(d.unused_data)) if d.eof else "member without end"


class _Lines:
    """Version lines of a file, looked for once: the next one is remembered until it is passed."""

    def __init__(self, data: bytes):
        self.data, self.found = data, -1

    def after(self, at: int) -> int:
        if self.found < at:
            m = _VERSION.search(self.data, at)
            self.found = m.start() if m else len(self.data)
        return self.found


def _next(data: bytes, view: memoryview, at: int, lines: _Lines) -> int:
    """Where the next record may start: a member that begins with a version line, or a version line."""
    stop = lines.after(at)
    found = data.find(_MEMBER, at, stop)
    while found >= 0:
        got = _inflate(view, found, 8)
        if not isinstance(got, str) and (got[0].startswith(b"WARC/") or data.startswith(EMPTY_MEMBER, found)):
            return found
        found = data.find(_MEMBER, found + 1, stop)
    return stop


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """Records (offset, length, header, block) and gaps (offset, length, None, reason) of a file, in order; they cover it."""
    view, at, lines = memoryview(data), 0, _Lines(data)
    while at < len(data):
        if data.startswith(_MEMBER, at):
            got = _inflate(view, at)
            if not isinstance(got, str):
                content, end = got
                if not content:
                    at = end
                    continue
                checked = _checked(content)
                if not isinstance(checked, str):
                    yield at, end - at, *checked
                    at = end
                    continue
                got = checked
        elif m := _VERSION.match(data, at):
            # a plain record ends where its length says; without a usable length, the check fails
            head = data.find(b"\r\n\r\n", m.end())
            size = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", data[at:head]) if head >= 0 else None
            end = head + 8 + int(size[1]) if size else at
            got = _checked(data[at:end]) if size else "no length"
            if not isinstance(got, str):
                yield at, end - at, *got
                at = end
                continue
        else:
            got = "neither a member nor a version line"
        end = _next(data, view, at + 1, lines)
        yield at, end - at, None, got
        at = end


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows of records and gaps: file, offset, length, gap (reason; null for records), record_type, page_id, target_uri, refers_to,
    payload_digest, payload_bytes (null for revisits) and, if wanted, payload."""
    extra = [("payload", pa.binary())] if with_payload else []
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), *extra])
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, data, out = b.column(0)[i].as_py(), b.column(1)[i].as_py(), []
                for at, size, head, block in salvage(data):
                    row = {"file": file, "offset": at, "length": size}
                    if head is None:
                        row["gap"] = block
                    else:
                        whole = payload(block) if head.get("warc-type") == "response" else None
                        row |= {"record_type": head.get("warc-type"), "page_id": number(head.get("warc-record-id")), "target_uri": head.get("warc-target-uri"), "refers_to": number(head.get("warc-refers-to"))}
                        row |= {"payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:"), "payload_bytes": None if whole is None else len(whole)}
                        if with_payload:
                            row["payload"] = whole
                    out.append(row)
                    if len(out) == 512:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    kinds = "file string, offset long, length long, gap string, record_type string, page_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, kinds)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit has its response's length."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    records = written(read_archives(spark, path).where("gap IS NULL"), "warc-records")
    # a page id may be repeated, so the response is the one with the digest too; only responses that are referred to can move
    asked = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    responses = records.where("record_type = 'response'").join(asked, ["page_id", "payload_digest"], "left_semi")
    responses = responses.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    out = records.join(responses, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
