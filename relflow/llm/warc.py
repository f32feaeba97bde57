"""WARC archives: a writer with identical-payload revisits and a splittable reader.

Writing.  A first pass digests every payload and finds, per payload, the row of its smallest id; the
others become revisit records, which name that record's id, URI and date.  Payloads are the same with
the same SHA-256 (the SHA-1 of the format is too weak to stand for a payload).  Verdicts go back to the
rows by locator, and revisits carry no payload, so no payload is ever shuffled.  Archives are written by tasks (one gzip member per record)
under a name of their own and renamed when whole, so a retried or lost task leaves at most an
unlisted file; only the archives in the written manifest are read.

Reading.  An archive is cut into byte ranges.  A task finds the gzip magic in its range, takes a
candidate for a member only if it decodes to a WARC header, and owns the records that start
inside the range; the last one is read past the range's end.  From there members follow each
other, and the scan resumes only behind damage.  Memory is bounded by the largest record plus a
read buffer; no task ever needs a whole archive.

Defined results: null payloads count as empty and are records too.  Of equal payloads of at
least ``min_revisit`` bytes the smallest id is the response (null ids last; rows that repeat that
id are responses as well), the others revisit it.  An empty table writes no archive and gives
no rows.  Columns other than id, URL and payload never enter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anchored, cut, flagged, join_skewed, numbered, remove, scratch, table, text_of

ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 32 << 20
#: Reading tasks at most; beyond it a task reads several ranges one after another.
MAX_TASKS = 100_000
LEVEL = 4
_MAGIC = b"\x1f\x8b\x08"
_BUFFER = 1 << 20
_DATE = "2000-01-01T00:00:00Z"
_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, target_id string, target_uri string, archive string, at long"
#: Record ids are name-based UUIDs below this one: of the run, the file and the row.
_SPACE = uuid.UUID("8e7d6fbc-97a8-4f4a-a4f5-6b1f1c1d7a52")
_WRITTEN = ["page_id", "url", "payload", "size", "digest", "name", "refers_to", "target", "target_uri"]


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 0) -> DataFrame:
    """page_id, url, payload (UTF-8; null for revisits), size, digest (SHA-1 hex), name, and of revisits refers_to, target (name) and target_uri."""
    own, key, url, payload = numbered(pages, key, url, payload)
    run = uuid.uuid4().hex
    name = F.concat_ws("/", F.lit(run), "__file", "__row")
    rows = anchored(own).select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(text_of(payload), "UTF-8").alias("payload"), "__file", "__row")
    sized = rows.select("page_id", "url", "__file", "__row", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("same"))
    slim = cut(sized, "digests")
    firsts = slim.filter(F.col("size") >= min_revisit).groupBy("same").agg(F.min(F.struct(F.col("page_id").isNull().alias("void"), "page_id", "__file", "__row", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.filter("n > 1 and first.page_id is not null"), "firsts")
    again = join_skewed(slim, firsts, ["same"], "n", slim.count()).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    again = cut(again.select(*slim.columns, F.col("first.page_id").alias("refers_to"), F.concat_ws("/", F.lit(run), "first.__file", "first.__row").alias("target"), F.col("first.url").alias("target_uri")), "revisits")
    none = F.lit(None)
    responses = flagged(rows, again).filter("not __hit").withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "name": name, "refers_to": none.cast("long"), "target": none.cast("string"), "target_uri": none.cast("string")})
    revisits = again.withColumns({"payload": none.cast("binary"), "name": name})
    return responses.select(*_WRITTEN).unionByName(revisits.select(*_WRITTEN))


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def record(page_id, url, payload: bytes | None, size: int, digest_hex: str, name: str, refers_to=None, target: str | None = None, target_uri: str | None = None, level: int = LEVEL) -> bytes:
    """One gzip member holding one record; without a payload a revisit of the record ``target``."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(name)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'null' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_clean(url)}")
    if target is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(target)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To: {refers_to}"]
        if target_uri is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(target_uri)}")
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block + b"\r\n\r\n") + z.flush()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives from ``with_revisits`` rows; the manifest (archive, bytes, records) of the whole ones."""
    folder = _uri(folder)

    def run(batches):
        fs, top = _fs(folder)
        fs.create_dir(top, recursive=True)
        out = name = None
        size = count = 0

        def close():
            nonlocal out
            out.close()
            fs.move(f"{top}/{name}.open", f"{top}/{name}.warc.gz")
            out = None
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["archive", "bytes", "records"])

        for batch in batches:
            for r in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    name, size, count = uuid.uuid4().hex, 0, 0
                    out = fs.open_output_stream(f"{top}/{name}.open")
                data = record(*(x.as_py() for x in r), level=level)
                out.write(data)
                size += len(data)
                count += 1
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return cut(rows.select(*_WRITTEN).mapInArrow(run, "archive string, bytes long, records long"), "manifest")


class _Window:
    """Bytes of a file from a place on, read as needed, forgotten once passed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.size, self.base = file, size, at
        self.data = bytearray()

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.base + len(self.data)
        if end > have:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, min(_BUFFER, self.size - have)))

    def bytes(self, at: int, n: int) -> bytes:
        self.upto(at + n)
        return bytes(memoryview(self.data)[at - self.base : at - self.base + n])

    def find(self, what: bytes, at: int, end: int) -> int:
        """First place in [at, end) where ``what`` starts, or -1."""
        while at < end:
            self.upto(at + _BUFFER + len(what))
            stop = min(end + len(what) - 1, self.base + len(self.data))
            hit = self.data.find(what, at - self.base, stop - self.base)
            if hit >= 0:
                return self.base + hit
            if stop >= min(end + len(what) - 1, self.size):
                return -1
            at = stop - len(what) + 1
            self.forget(at)
        return -1

    def forget(self, at: int) -> None:
        if at - self.base > _BUFFER:
            del self.data[: at - self.base]
            self.base = at


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at ``at`` and the place behind it; None if there is no record."""
    z = zlib.decompressobj(31)
    out, place, head = [], at, b""
    try:
        while not z.eof:
            raw = window.bytes(place, 1 << 16)
            if not raw:
                return None
            out.append(z.decompress(raw))
            place += len(raw)
            if len(head) < 5:  # enough decoded to see whether this is a record at all
                head += out[-1][:5]
                if not head.startswith(b"WARC/"[: len(head)]):
                    return None
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, place - len(z.unused_data)) if data.startswith(b"WARC/") and b"\r\n\r\n" in data else None


def records_from(file, size: int, start: int, end: int):
    """(offset, decoded record) of every record that starts in [start, end)."""
    window = _Window(file, start, size)
    at = start
    while 0 <= at < end:
        at = window.find(_MAGIC, at, min(end, size))
        if at < 0:
            return
        got = _member(window, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]
        window.forget(at)


def decode(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: None if x in (None, "null") else int(x)
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "page_id": number(fields.get("x-page-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": number(fields.get("x-refers-to")),
        "payload_bytes": len(payload) if kind == "response" else int(fields["x-payload-length"]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
        "record_id": fields["warc-record-id"],
        "target_id": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-refers-to-target-uri"),
    }


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the manifest's archives; payload is null for revisits (and without ``payloads``)."""
    ranges = manifest.filter("bytes > 0").select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    # a fixed number: sized by bytes of ranges rather than of this slim table, which would go to one task
    ranges = ranges.repartition(max(1, min(ranges.count(), MAX_TASKS)), "archive", "start")

    def run(batches):
        from relflow.llm.warc import _fs, decode, records_from

        for batch in batches:
            for archive, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = _fs(archive)
                held, weight = [], 0
                with fs.open_input_file(path) as file:
                    for at, data in records_from(file, size, start, min(start + range_bytes, size)):
                        row = decode(data) | {"archive": archive, "at": at}
                        if not payloads:
                            row["payload"] = None
                        weight += len(row["payload"] or b"") + 200
                        held.append(row)
                        if weight > 4 << 20:
                            yield _batch(held)
                            held, weight = [], 0
                if held:
                    yield _batch(held)

    return ranges.mapInArrow(run, _READ)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("target_id", pa.string()), ("target_uri", pa.string()), ("archive", pa.string()), ("at", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])


def whole(manifest: DataFrame, records: DataFrame) -> None:
    """Fail where not as many records were read as the manifest's archives hold."""
    written, got = manifest.agg(F.sum("records")).first()[0] or 0, records.count()
    if written != got:
        raise ValueError(f"{got} records read of {written} written")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write(with_revisits(table(spark, sf_dir, "pages")), folder)
    back = cut(read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    whole(manifest, back)
    remove(spark, folder)
    return back


#: DuckDB's digest is hexadecimal; five bits at a time give the base32 letters.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda g:
    array_to_string(list_transform(range(4), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(x, CAST(5 * g + 1 AS INTEGER), 5)) AS BIGINT) >> (15 - 5 * i)) & 31 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
