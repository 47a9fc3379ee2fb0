"""WARC archives: a writer of one gzip member per record and a splittable
reader.

Reading needs no index. A task gets a byte range of an archive, scans it for
the gzip magic, validates every candidate by inflating it and decoding the
record's header, and owns the records whose member starts inside its range;
the last one is read on past the end of the range. Files are opened with
pyarrow's file systems, so a range read touches that range only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodgauge.llm.common import map_arrow, scratch, written
from moodgauge.session import ensure_checkpoint_dir, ship_package

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 19
PIECE_BYTES = 1 << 14
# a payload of fewer bytes is always stored in full
MIN_REVISIT_BYTES = 0
MANIFEST = "path string, bytes long, records long"
_URN = "<urn:x-page:{}>"
_URN_ID = re.compile(r"<urn:x-page:(-?\d+)>")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if not urlparse(path).scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path)))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --------------------------------------------------------------------------
# Writing
# --------------------------------------------------------------------------

def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member holding one record. A revisit has the HTTP header
    only; both kinds name the length and digest of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {url}')}>" if page_id is None
             else _URN.format(page_id)),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", "sha1:" + digest(payload)),
            ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", _URN.format(refers_to))]
    head.append(("Content-Length", str(len(body))))
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw.encode() + body + b"\r\n\r\n") + z.flush()


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(digest, size, first): payloads that several rows have, with the
    largest id of them."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return (pages.select(F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"),
                         F.col(id_col).cast("long").alias("id"))
            .where(F.col("size") >= min_bytes)
            .groupBy("digest", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1 and first is not null").select("digest", "size", "first"))


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write one record per row and return the archives: (path, bytes,
    records), also written as a manifest beside them.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest id is a response and the others revisit it; smaller payloads
    are responses each. Null payloads count as empty. Rows that repeat the
    largest id with the same payload are all responses; a row without an id
    revisits if any equal row has an id and is a response otherwise. A task
    writes one archive under a name of its own and reports it only when it is
    closed; what a lost attempt left behind is in no manifest."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    base = path or scratch(spark, "warc")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"),
                        F.octet_length(payload).alias("size"))
    rows = rows.join(written(revisits(pages, f"`{id_col}`", f"`{payload_col}`", min_bytes), "copies"), ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    rows = rows.select("id", "url", "payload", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
                       F.when(again, F.col("first")).alias("refers_to"))
    ship_package(spark)

    def write(batches):
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        fs, at = open_fs(name)
        out, n, size = None, 0, 0
        for batch in batches:
            for page_id, url, body, kind, ref in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)   # the records are compressed one by one
                raw = record(kind, page_id, url, body.encode(), ref)
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    cols = rows.select("id", "url", "payload", "kind", "refers_to")
    manifest = f"{base.rstrip('/')}/manifest"
    cols.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


# --------------------------------------------------------------------------
# Reading
# --------------------------------------------------------------------------

class _Window:
    """A file read forward in pieces, of which the unread part is kept."""

    def __init__(self, file, start: int, size: int):
        self.file, self.size = file, size
        self.at = start             # place of buf[pos] in the file
        self.buf, self.pos = b"", 0

    def peek(self, skip: int, n: int) -> bytes:
        """At most ``n`` bytes from ``skip`` bytes on; empty at the end."""
        if len(self.buf) - self.pos < skip + n:
            held = self.buf[self.pos:]
            ahead = self.at + len(held)
            if ahead < self.size:
                held += self.file.read_at(min(READ_BYTES, self.size - ahead), ahead)
                self.buf, self.pos = held, 0
        return self.buf[self.pos + skip:self.pos + skip + n]

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n


def _inflate(window: _Window) -> tuple[bytes, int] | None:
    """The member that starts at the window and its length in the file, or
    None if what starts there is no whole gzip member with a record header."""
    z, out, used = zlib.decompressobj(31), b"", 0
    parts = []
    while not z.eof:
        piece = window.peek(used, PIECE_BYTES)
        if not piece:
            return None
        try:
            parts.append(z.decompress(piece))
        except zlib.error:
            return None
        used += len(piece) - len(z.unused_data)
        if len(out) < 5:
            out += parts[-1][:5]
            if not b"WARC/".startswith(out[:5]):
                return None
    return b"".join(parts), used


def parse(member: bytes) -> tuple[dict[str, str], bytes] | None:
    """(header, body) of a record, or None if the header does not decode or
    does not fit the body."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return None
    try:
        pairs = [line.decode().partition(":") for line in lines[1:]]
    except UnicodeDecodeError:
        return None
    header = {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}
    length = header.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return header, rest[:int(length)]


def read_range(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, body) of the records whose member starts in
    [start, end) of the archive."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as file:
        window = _Window(file, start, size)
        while window.at < end:
            ahead = window.peek(0, PIECE_BYTES)
            if len(ahead) < len(MAGIC):
                return
            hit = ahead.find(MAGIC)
            if hit != 0:    # not at a member: go on to the next magic
                window.skip(hit if hit > 0 else len(ahead) - len(MAGIC) + 1)
                continue
            member = _inflate(window)
            found = parse(member[0]) if member else None
            if found is None:
                window.skip(1)
                continue
            yield window.at, *found
            window.skip(member[1])


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of ``archives`` (path, bytes): path, offset, record_type,
    page_id, url, payload_bytes, payload_digest, refers_to, payload.

    Of responses, length and digest are those of the payload as read; of
    revisits, which hold none, those their header names. Bytes that belong to
    no valid record are passed over. An archive inside an archive that was
    stored without compression may be taken for records of its own."""
    ranges = archives.select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(max(1, min(n, 100_000))), F.xxhash64("path", "start"))

    def run(batch: pa.RecordBatch):
        for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
            names = ("path", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload")
            out: dict[str, list] = {k: [] for k in names}
            held = 0
            for offset, header, body in read_range(path, start, start + split_bytes, size):
                kind = header.get("warc-type", "")
                page = _URN_ID.fullmatch(header.get("warc-record-id", ""))
                ref = _URN_ID.fullmatch(header.get("warc-refers-to", ""))
                payload = body.partition(b"\r\n\r\n")[2] if kind != "revisit" else None
                n_bytes = len(payload) if payload is not None else int(header.get("x-payload-length", 0))
                sha = digest(payload) if payload is not None else header.get("warc-payload-digest", "").removeprefix("sha1:")
                row = (path, offset, kind, page and int(page[1]), header.get("warc-target-uri"), n_bytes, sha, ref and int(ref[1]), payload)
                for k, v in zip(names, row):
                    out[k].append(v)
                held += len(body)
                if held > READ_BYTES:
                    yield out
                    out, held = {k: [] for k in names}, 0
            yield out

    return map_arrow(ranges.select("path", "bytes", "start"), run,
                     "path string, offset long, record_type string, page_id long, url string, payload_bytes long, "
                     "payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` to archives and read the archives back."""
    return read_archives(write_archives(pages, path, **columns))
