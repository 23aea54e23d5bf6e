"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  The reader cuts archives into byte
ranges; a task scans its range for the gzip magic, validates a candidate by
inflating it and parsing the WARC header, and owns the records that start in
its range (it reads past the end of the range to finish the last one).  After
a valid member the next one starts where it ended, so payload bytes that look
like a gzip header are never taken for a record; a candidate found by scanning
must also be followed by the end of the file or another valid member.  A task
reads its bytes once, through one buffer that starts at the record at hand.

Record type ``response`` carries an HTTP response with the payload; of records
with equal payloads of at least ``min_revisit`` bytes, that with the largest
id is the response and the others are ``revisit`` records that refer to it.
Records of other types and other writers are read as well: their block (of
application/http the part after the head) is the payload, and ids that are not
made here read as null.  A payload that is not that of its digest reads as
``intact`` false, without a known digest as null; bytes that are no record where
one must start are an error with their place.

Nulls: a null payload is empty, a null url is written as an empty target, a
null id writes a record without the id and reads back as null; rows that share
the largest id of their payload are all responses.  An empty table writes
no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import file_system, fresh_path, materialise

#: Fixed values of the format.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
URN_SPACE = 0x6F1B3C52A0E84D17
MIN_REVISIT = 1000
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
STEP_BYTES = 1 << 14
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def record_urn(page_id: int) -> bytes:
    """Record id that holds the page id in its low half."""
    return b"<urn:uuid:%s>" % str(uuid.UUID(int=URN_SPACE << 64 | page_id & (1 << 64) - 1)).encode()


def page_of(urn: bytes | None) -> int | None:
    """Inverse of :func:`record_urn`; null for ids made otherwise."""
    try:
        number = uuid.UUID((urn or b"").strip(b"<>").decode().removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if number >> 64 != URN_SPACE:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    body = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    urn = record_urn(page_id) if page_id is not None else b"<%s>" % uuid.uuid5(uuid.NAMESPACE_URL, url or "").urn.encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + urn,
        b"WARC-Date: 2024-01-01T00:00:00Z",
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()),
        b"Content-Type: application/http;msgtype=response",
        b"Content-Length: %d" % len(body),
    ]
    if revisit:
        lines[2:2] = [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + record_urn(refers_to)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(CRLF.join(lines) + CRLF * 2 + body + CRLF * 2) + packer.flush()


def header_fields(head: bytes) -> dict[bytes, bytes]:
    """Fields by lower-case name; a line that opens with white space goes on with the one before, lines without a colon are left out."""
    lines: list[bytes] = []
    for line in head.split(CRLF)[1:]:
        if line[:1] in (b" ", b"\t") and lines:
            lines[-1] += b" " + line.strip()
        else:
            lines.append(line)
    return {name.strip().lower(): value.strip() for name, colon, value in (x.partition(b":") for x in lines) if colon}


def known_digest(value: bytes | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a labelled digest in hex or base 32; null for others."""
    name, _, digest = (value or b"").decode("ascii", "replace").partition(":")
    name, digest = name.lower().replace("-", ""), digest.strip()
    size = DIGEST_BYTES.get(name)
    if not size:
        return None
    try:
        raw = bytes.fromhex(digest) if len(digest) == 2 * size else base64.b32decode(digest.upper() + "=" * (-len(digest) % 8))
    except ValueError:
        return None
    return (name, raw.hex()) if len(raw) == size else None


def parse_record(raw: bytes) -> dict | None:
    """Fields of an inflated record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact, payload; None if it is none.

    Of a revisit, which holds no payload, length and digest are those it states.
    """
    head, found, rest = raw.partition(CRLF * 2)
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = header_fields(head)
    size = fields.get(b"content-length", b"")
    if b"warc-type" not in fields or not size.isdigit() or len(rest) < int(size) or rest[int(size) :].strip(CRLF):
        return None
    kind, block = fields[b"warc-type"].decode("utf-8", "replace").lower(), rest[: int(size)]
    http, payload = b"", block
    if fields.get(b"content-type", b"").lower().startswith(b"application/http"):
        http, _, payload = block.partition(CRLF * 2)
    told = known_digest(fields.get(b"warc-payload-digest"))
    length, digest, intact = len(payload), hashlib.sha1(payload).hexdigest(), None
    if kind == "revisit":
        stated = header_fields(http).get(b"content-length", b"")
        length = int(stated) if stated.isdigit() else None
        digest = told[1] if told and told[0] == "sha1" else None
    elif told:
        intact = hashlib.new(told[0], payload).hexdigest() == told[1]
    return {
        "page_id": page_of(fields.get(b"warc-record-id")),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_of(fields.get(b"warc-refers-to")),
        "intact": intact,
        "payload": None if kind == "revisit" else payload,
    }


class RangeReader:
    """Records of one file that start in [start, end); ``bytes_read`` counts what was read."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.bytes_read = stream, size, 0
        self.base, self.data = 0, bytearray()

    def _ahead(self, offset: int) -> memoryview:
        """Bytes of the buffer from ``offset`` on, read if there are none; empty at the end of the file."""
        end = self.base + len(self.data)
        if offset >= end:
            if offset > end:
                self.base, self.data, end = offset, bytearray(), offset
            self.stream.seek(end)
            more = self.stream.read(READ_BYTES)
            self.bytes_read += len(more)
            self.data += more
        return memoryview(self.data)[offset - self.base :]

    def _forget(self, offset: int) -> None:
        """Drop what lies before ``offset``."""
        if offset - self.base >= READ_BYTES or offset >= self.base + len(self.data):
            self.data = self.data[offset - self.base :]
            self.base = offset

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """Inflated member at ``offset`` and where the next one starts; None if none is there."""
        inflate, parts, at, head = zlib.decompressobj(31), [], offset, b""
        try:
            while not inflate.eof:
                with self._ahead(at) as ahead:
                    chunk = bytes(ahead[:STEP_BYTES])
                if not chunk:
                    return None
                parts.append(inflate.decompress(chunk))
                at += len(chunk)
                if len(head) < 7:
                    head = b"".join(parts)[:7]
                    if not b"WARC/1.".startswith(head):
                        return None
        except zlib.error:
            return None
        return b"".join(parts), at - len(inflate.unused_data)

    def record(self, offset: int) -> tuple[dict, int] | None:
        """The record at ``offset`` and where the next one starts; None if none is there."""
        found = self.member(offset)
        record = found and parse_record(found[0])
        return (record, found[1]) if record else None

    def _first(self, start: int, end: int) -> int | None:
        """The first record start in [start, end)."""
        at = start
        while at < end:
            self._forget(at)
            with self._ahead(at):
                k = self.data.find(GZIP_MAGIC, at - self.base)
            if k < 0:  # the buffer's last two bytes may open a magic
                stop = self.base + len(self.data)
                at = max(at + 1, stop - len(GZIP_MAGIC) + 1)
                self._ahead(stop)
                if self.base + len(self.data) == stop:
                    return None
                continue
            at = k + self.base
            if at < end and (found := self.record(at)) and (found[1] >= self.size or self.record(found[1])):
                return at
            at += 1
        return None

    def records(self, start: int, end: int) -> Iterator[dict]:
        """Every record that starts in the range, in order."""
        at = start if start == 0 else self._first(start, end)
        while at is not None and at < min(end, self.size):
            self._forget(at)
            found = self.record(at)
            if not found:
                raise ValueError(f"no WARC record at byte {at}")
            record, at = found
            yield record


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                record = make_record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["refers_to"])
                out.write(record)
                size, n = size + len(record), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [size], "n_records": [n]})

    return write


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, hot_copies: int = 10_000) -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns the manifest (file, n_bytes, n_records) as a written table.

    Files carry the name of the task attempt; only files of finished tasks are
    in the manifest.  Payloads with over ``hot_copies`` copies, and over a
    10,000th of all pages, are looked up apart, so that their pages stay spread.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    # one row per payload that repeats: a count per key combines before the shuffle
    kept = (
        rows.filter(F.col("size") >= min_revisit)
        .groupBy(F.col("digest").alias("d"), F.col("size").alias("n"))
        .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("kept_id"))
        .filter("copies > 1")
    )
    kept = materialise(kept, "warc-payloads")
    repeated = kept.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") > max(hot_copies, repeated // 10_000)
    hot = kept.filter(is_hot).select(F.col("d").alias("hot_d"), F.col("n").alias("hot_n"), F.col("kept_id").alias("hot_id"))
    marked = rows.join(F.broadcast(hot), (F.col("digest") == F.col("hot_d")) & (F.col("size") == F.col("hot_n")), "left")  # under 10,000 rows
    # pages of a hot payload need no second lookup: a key of their own keeps them from meeting in one task
    key = F.when(F.col("hot_d").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    cold = kept.filter(~is_hot).select("d", "n", "kept_id")
    response = F.coalesce("hot_id", "kept_id")
    joined = marked.withColumn("key", key).join(cold, (F.col("key") == F.col("d")) & (F.col("size") == F.col("n")), "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(response), response).alias("refers_to")
    )
    return materialise(joined.mapInArrow(_writer(folder), "file string, n_bytes long, n_records long"), "warc-manifest")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _reader(folder: str, with_payload: bool):
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)

        def flush(rows):
            return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kind) for c, kind in zip(names, kinds, strict=False)})

        for batch in batches:
            for job in batch.to_pylist():
                with fs.open_input_file(f"{root}/{job['file']}") as stream:
                    rows, held = [], 0
                    for record in RangeReader(stream, job["n_bytes"]).records(job["from"], job["to"]):
                        rows.append(record)
                        held += 100 + len(record["payload"] or b"") * with_payload
                        if held > 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                    if rows:
                        yield flush(rows)

    return read


def read_warc(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the archives, one task per byte range."""
    ranges = manifest.select(
        "file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("from")
    ).withColumn("to", F.least(F.col("from") + split_bytes, "n_bytes"))
    n = max(1, ranges.count())
    return ranges.repartition(n, "file", "from").mapInArrow(_reader(folder, with_payload), READ_SCHEMA + ", payload binary" * with_payload)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Write a WARC record per page, then read the archives back; a payload that is not that of its digest is an error."""
    folder = fresh_path(spark, "warc")
    records = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)
    sound = F.when(F.col("intact") | F.col("intact").isNull(), F.col("page_id")).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("long"))
    return records.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes
  FROM pages),
k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS kept_id
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = kept_id THEN NULL ELSE kept_id END AS refers_to
FROM k
"""
