"""WARC archives: a writer with revisit records for equal payloads, and a salvage reader.

Files are ``.warc.gz``, a gzip member for each record. Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one
with the largest id is a response, the others are revisits that refer to it.

The reader checks every record: member, version line, header, length, block digest, closing line ends. Where a check fails it looks for the next
place where a valid member (or, in plain files and inside members, a valid version line and header) begins, goes on there, and reports the
bytes in between as a gap with the reason. Later records are recovered whatever lies before.

Defined results: a null payload is empty; rows with the same id and payload are all responses if their id is the largest; pages with a null
id never are what others refer to, unless no page with an id has the payload (then they are responses); a null address becomes the record's own name; control
characters and blanks in addresses are percent-encoded; an empty table gives no files and no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Folder, fresh_path, join_spread, stage

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r$")
_END = b"\r\n\r\n"
_MEMBER = b"\x1f\x8b\x08"
#: Bytes read or searched at a time.
STEP = 1 << 20
#: Bytes beyond which a task begins a new archive.
FILE_BYTES = 1 << 28
NO_END = "header has no end"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, uri: str, date: str, payload: bytes, payload_digest: str, payload_bytes: int, refers_to: str | None = None) -> bytes:
    """The bytes of one record, not compressed; payload is left out of a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri),
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest32(block)}",
        **({"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE} if refers_to else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + _END


def write(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4, folder: str | None = None) -> DataFrame:
    """Write all pages -> manifest (file, records, bytes), staged; a task writes files of about ``FILE_BYTES`` under names of its own attempt.

    Digests of equal payloads are found on ids and digests alone; pages of a very common payload then stay in the tasks that read them.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    src = src.withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    src = src.withColumn("key", F.concat("sha1", F.col("size").cast("string").cast("binary")))
    one = F.when(F.first("size") >= revisit_bytes, F.max("page_id")).alias("first")
    same = stage(src.select("key", "size", "page_id").groupBy("key").agg(one, F.count("*").alias("n")), "digests")
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = join_spread(src, same, "key", total).select("page_id", "uri", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        from pyspark import TaskContext

        tc, made = TaskContext.get(), []

        def member(i, uri, body, sha1, refers_to) -> bytes:
            own = f"urn:x-page:{i}" if i is not None else f"urn:uuid:{uuid.uuid4()}"
            kind, to = ("response", None) if refers_to is None else ("revisit", f"urn:x-page:{refers_to}")
            c = zlib.compressobj(level, zlib.DEFLATED, 31)
            return c.compress(record(kind, own, uri or own, date, body, base64.b32encode(sha1).decode(), len(body), to)) + c.flush()

        members = (member(*x) for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(5))))
        held = next(members, None)
        while held is not None:
            n, size = 0, 0

            def some():
                nonlocal held, n, size
                while held is not None and size < FILE_BYTES:
                    n, size = n + 1, size + len(held)
                    yield held
                    held = next(members, None)

            name = f"pages-{tc.partitionId():06d}-{len(made):05d}-{tc.taskAttemptId()}.warc.gz"
            made.append(name)
            Folder(folder).write(name, some())
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    manifest = stage(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")
    manifest.folder = folder
    return manifest


class Gap(Exception):
    """What is wrong with the bytes at a place."""


def _find(f, pattern: bytes, at: int) -> Iterator[int]:
    """Places of pattern from at on, some bytes at a time."""
    f.seek(at)
    held, base = b"", at
    while chunk := f.read(STEP):
        held += chunk
        k = -1
        while (k := held.find(pattern, k + 1)) >= 0:
            yield base + k
            f.seek(base + len(held))
        keep = min(len(held), len(pattern) - 1)
        base += len(held) - keep
        held = held[len(held) - keep :]
        f.seek(base + len(held))


def _header(f, at: int) -> bytes:
    """The header at a place of a plain stream, of any length; Gap if there is none."""
    f.seek(at)
    head = bytearray(f.read(4096))
    if not _VERSION.match(head):
        raise Gap("no version line")
    seen = 0
    while (k := head.find(_END, seen)) < 0:
        seen = max(0, len(head) - len(_END) + 1)
        if not (more := f.read(min(STEP, len(head)))):
            raise Gap(NO_END)
        head += more
    return bytes(head[:k])


def _record(f, at: int) -> tuple[dict[str, str], bytes, int]:
    """(header, block, end) of the record at a place of a plain stream; Gap if a check fails."""
    raw = _header(f, at)
    if not (m := _LENGTH.search(raw + b"\r")):
        raise Gap("no content length")
    fields = {}
    for line in raw.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Gap("bad header line")
        fields[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    f.seek(at + len(raw) + len(_END))
    n = int(m[1])
    block = f.read(n)
    if len(block) < n or f.read(len(_END)) != _END:
        raise Gap("block cut short or without its end")
    kind, _, said = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and said != digest32(block):
        raise Gap("block digest differs")
    return fields, block, at + len(raw) + 2 * len(_END) + n


def plain(f) -> Iterator[tuple]:
    """("record", start, end, header, block) and ("gap", start, end, reason) of a plain stream."""
    f.seek(0, 2)
    size, at = f.tell(), 0
    while at < size:
        try:
            head, block, end = _record(f, at)
        except Gap as why:
            for k in _find(f, b"WARC/1.", at + 1):
                try:
                    if _LENGTH.search(_header(f, k) + b"\r"):
                        end = k
                        break
                except Gap as no:
                    if str(no) == NO_END:  # nor has any header after it
                        end = size
                        break
            else:
                end = size
            yield "gap", at, end, str(why)
        else:
            yield "record", at, end, head, block
        at = end


def _member(f, at: int, most: int | None = None) -> tuple[bytes, int]:
    """(data, end) of the gzip member at a place, or its first bytes; Gap if it is broken."""
    f.seek(at)
    d, out, n = zlib.decompressobj(31), [], 0
    while not d.eof:
        if not (chunk := f.read(min(STEP, most or STEP))):
            raise Gap("member cut short")
        try:
            out.append(d.decompress(chunk))
        except zlib.error as e:
            raise Gap(f"member broken: {e}") from None
        n += len(chunk)
        if most and sum(map(len, out)) >= 8:
            break
    return b"".join(out), at + n - len(d.unused_data)


def compressed(f) -> Iterator[tuple]:
    """As plain(), of a stream of gzip members; places are those of the members."""
    f.seek(0, 2)
    size, at = f.tell(), 0
    while at < size:
        try:
            data, end = _member(f, at)
        except Gap as why:
            end = size
            for k in _find(f, _MEMBER, at + 1):
                try:
                    if _member(f, k, 512)[0].startswith(b"WARC/1."):
                        end = k
                        break
                except Gap:
                    pass
            yield "gap", at, end, str(why)
        else:
            for x in plain(io.BytesIO(data)):
                yield x[0], at, end, *x[3:]
        at = end


def salvage(f) -> Iterator[tuple]:
    f.seek(0)
    start = f.read(3)
    return compressed(f) if start == _MEMBER or not start.startswith(b"W") and any(True for _ in _find(f, _MEMBER, 0)) else plain(f)


_SCHEMA = "file string, start long, end long, gap string, record_type string, record_id string, uri string, payload_digest string, payload_bytes long, refers_to string"


def read(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each record and each gap of the files (file), a task for each file; gap has the reason, records have none."""

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with Folder(folder).open(name) as f:
                    rows, held = [], 0
                    for x in salvage(f):
                        if x[0] == "gap":
                            rows.append((name, x[1], x[2], x[3], *[None] * (6 + with_payload)))
                        else:
                            h, block = x[3], x[4]
                            http, _, payload = block.partition(_END)
                            kind = h.get("warc-type")
                            said = h.get("warc-payload-digest", "").partition(":")[2] or None
                            if kind == "revisit":
                                n, payload = int(m[1]) if (m := _LENGTH.search(http + b"\r")) else None, None
                            else:
                                n, said = len(payload), digest32(payload)
                            rows.append((name, x[1], x[2], None, kind, h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), said, n, h.get("warc-refers-to", "").strip("<>") or None, *[payload] * with_payload))
                            held += len(block) * with_payload
                        if len(rows) >= 2000 or held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    s, i = pa.string(), pa.int64()
    types = (s, i, i, s, s, s, s, s, i, s, pa.binary())
    names = [*(x.split()[0] for x in _SCHEMA.split(", ")), "payload"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[: len(rows[0])])

    task = (F.row_number().over(Window.orderBy("file")) - 1).alias("task")  # a row for each file
    return files.select("file", task).repartitionById(max(1, files.count()), "task").select("file").mapInArrow(run, _SCHEMA + ", payload binary" * with_payload)
