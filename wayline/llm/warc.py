"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The salvage reader walks a file record by record, plain or one gzip member a record. Each record must pass its checks:
version line, length, end of record, gzip checksum, block and payload digests. Where one fails, the reader searches
for the next gzip member or version line that begins a valid record, goes on there, and logs the bytes between
as a quarantined gap. No later record is lost with a damaged one.

Archives lie in a folder that all executors share. A task writes under a name of its own attempt and only the
manifest of the tasks that succeeded says which files count, so a lost executor leaves no half archive in it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch_path, stage

LEAST_SHARED = 100
ARCHIVE_BYTES = 64 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

# ---------------------------------------------------------------- writing


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with an HTTP head and the payload, or a revisit with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_urn(page_id) -> str:
    """The name of a page's record; that of a page without an id ends after the colon."""
    return "urn:page:" + ("" if page_id is None else quote(str(page_id), safe=""))


def clean_uri(uri: str | None, fallback: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in uri) if uri else fallback


def with_roles(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Add payload, digest and first_id: the smallest page_id with an equal payload of `least` bytes or more, where that
    is another page. Digests meet in a pre-aggregated table of (digest, id); payloads stay where they are unless many
    payloads are repeated."""
    d = pages.withColumn("payload", F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")))
    d = d.withColumn("digest", F.sha2("payload", 256))
    # Short payloads have no key: they meet nowhere, however many pages are empty.
    d = d.withColumn("__key", F.when(F.octet_length("payload") >= least, F.col("digest")))
    firsts = stage(d.where("__key is not null").groupBy("digest").agg(F.min(page_id).alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"), "firsts")
    d = d.join(firsts.withColumnRenamed("digest", "__d"), F.col("__key") == F.col("__d"), "left").drop("__d", "__key")
    return d.withColumn("first_id", F.when(F.col("first_id") != F.col(page_id), F.col("first_id")))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", gzip: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of with_roles(); return the manifest (file, bytes, records), itself written to `folder`."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        size = records = 0
        for b in batches:
            for pid, uri, payload, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, size, records = f"{root}/{uuid.uuid4().hex}.warc" + ".gz" * gzip, 0, 0
                    out = store.open_output_stream(name, compression=None)
                record = record_bytes("response" if first is None else "revisit", page_urn(pid), clean_uri(uri, page_urn(pid)), payload, digest, None if first is None else page_urn(first))
                data = gzip_member(record) if gzip else record
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "records": records}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "bytes": size, "records": records}])

    rows = pages.select(page_id, url, "payload", "digest", "first_id").mapInArrow(run, "file string, bytes long, records long")
    rows.write.parquet(f"{folder}/manifest")
    return spark.read.schema(rows.schema).parquet(f"{folder}/manifest")


# ---------------------------------------------------------------- reading


class Damaged(Exception):
    """A check of a record failed."""


class Window:
    """Random access to a file through one cached window."""

    STEP = 1 << 20

    def __init__(self, file):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.start, self.data = at, self.file.read_at(min(max(n, self.STEP), self.size - at), at)
        return self.data[at - self.start : at - self.start + n]

    def find(self, at: int) -> int:
        """Where the next gzip member or version line may begin, from `at` on; the size if nowhere."""
        while at < self.size:
            part = self.read(at, self.STEP)
            found = [k for k in (part.find(b"\x1f\x8b\x08"), part.find(b"WARC/1.")) if k >= 0]
            if found:
                return at + min(found)
            if at + len(part) >= self.size:
                break
            at += len(part) - 6
        return self.size


def _check(wanted: str | None, data: bytes, what: str) -> None:
    name, _, value = (wanted or "").partition(":")
    kind = {"sha256": "sha256", "sha-256": "sha256", "sha1": "sha1", "sha-1": "sha1", "md5": "md5"}.get(name.lower())
    if kind:
        h = hashlib.new(kind, data)
        if value.lower() != h.hexdigest() and value.upper() != base64.b32encode(h.digest()).decode():
            raise Damaged(f"{what} digest differs")


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields (lower-case names) and the head's length."""
    stop = data.find(END)
    if not data.startswith(b"WARC/1."):
        raise Damaged("no version line")
    if stop < 0:
        raise Damaged("header does not end")
    fields: dict[str, str] = {}
    for line in data[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("broken header line")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    return fields, stop + 4


def parse_record(fields: dict[str, str], block: bytes) -> dict:
    _check(fields.get("warc-block-digest"), block, "block")
    kind, payload = fields.get("warc-type", ""), block
    if "application/http" in fields.get("content-type", ""):
        head = block.find(END)
        payload = block[head + 4 :] if head >= 0 else b""
    if kind != "revisit":
        _check(fields.get("warc-payload-digest"), payload, "payload")
    strip = lambda k: fields[k].strip("<>") if k in fields else None
    return {"kind": "record", "warc_type": kind, "record_id": strip("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": strip("warc-refers-to"), "declared_digest": fields.get("warc-payload-digest", "").partition(":")[2] or None, "payload": payload}


MAX_HEAD = 1 << 20


def record_at(w: Window, at: int) -> tuple[dict, int]:
    """The record that begins at a byte, and where it ends."""
    if w.read(at, 3) == b"\x1f\x8b\x08":
        z, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof and pos < w.size:
                part = w.read(pos, 1 << 16)
                parts.append(z.decompress(part))
                pos += len(part)
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        if not z.eof:
            raise Damaged("gzip member does not end")
        data = b"".join(parts)
        fields, head = parse_head(data)
        n = int(fields["content-length"])
        if data[head + n :] != END or len(data) != head + n + 4:
            raise Damaged("record does not end where its length says")
        return parse_record(fields, data[head : head + n]), pos - len(z.unused_data)
    if w.read(at, 7) != b"WARC/1.":
        raise Damaged("neither a gzip member nor a version line")
    step = 1 << 12
    while END not in (data := w.read(at, step)) and len(data) == step and step < MAX_HEAD:
        step *= 4
    fields, head = parse_head(data)
    n = int(fields["content-length"])
    if at + head + n + 4 > w.size:
        raise Damaged("file ends within the record")
    if w.read(at + head + n, 4) != END:
        raise Damaged("record does not end where its length says")
    return parse_record(fields, w.read(at + head, n)), at + head + n + 4


def salvage(file) -> Iterator[dict]:
    """Records and gaps of an open random-access file, in order: start, end, and a record's fields or a gap's reason."""
    w, at, gap, reason = Window(file), 0, None, ""
    while at < w.size:
        try:
            record, end = record_at(w, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = w.find(at + 1)
            continue
        if gap is not None:
            yield {"kind": "gap", "start": gap, "end": at, "reason": reason}
            gap = None
        yield record | {"start": at, "end": end}
        at = end
    if gap is not None:
        yield {"kind": "gap", "start": gap, "end": w.size, "reason": reason}


SCHEMA = "file string, kind string, start long, end long, warc_type string, record_id string, target_uri string, refers_to string, declared_digest string, payload binary, reason string"
_FIELDS = pa.schema([("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string())])


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Rows of SCHEMA for every record and gap of the files (column `file`, paths in folder's file system).

    kind is record or gap; a gap has only file, start, end and reason. Empty files give no rows. A task reads whole
    files; one record at a time is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_file(name) as f:
                    for row in salvage(f):
                        rows.append(row | {"file": name})
                        size += len(row.get("payload") or b"")
                        if size > 4 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)

    return files.select("file").mapInArrow(run, SCHEMA)


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write (page_id, url, html) as WARC, read it back, and return what the archives say of each page.

    page_id, payload_bytes, payload_digest, record_type and refers_to (a revisit has its response's bytes). Null html is
    an empty payload; a null url is written as the record's own name; a null page_id is a page that is never referred to, and its
    record a response. Two rows with one page_id are two records; with equal payloads both are responses. page_id may be a number
    or a string. Other columns are ignored. Fails if the archives give fewer records than were written, with the gaps' number.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    kind = pages.schema["page_id"].dataType
    manifest = write_archives(with_roles(pages.select("page_id", "url", "html")), folder)
    written = manifest.agg(F.count("*").alias("files"), F.sum("records").alias("records")).first()
    back = read_archives(manifest.repartition(min(max(1, written["files"]), 10_000), "file"), folder)
    page = lambda c: F.nullif(F.try_url_decode(F.regexp_extract(c, "^urn:page:(.*)$", 1)), F.lit("")).cast(kind)
    digest = F.when(F.col("warc_type") == "revisit", F.col("declared_digest")).otherwise(F.sha2("payload", 256))
    everything = stage(
        back.select("kind", "file", "start", "end", "reason", page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), page(F.col("refers_to")).alias("refers_to")),
        "records",
    )
    read = everything.agg(F.count(F.when(F.col("kind") == "record", 1)).alias("records"), F.count(F.when(F.col("kind") == "gap", 1)).alias("gaps")).first()
    if read["records"] != (written["records"] or 0):
        raise RuntimeError(f"{written['records']} records were written, {read['records']} were read; {read['gaps']} byte gaps")
    records = everything.where("kind = 'record'").drop("kind", "file", "start", "end", "reason")
    named = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("__page"), F.col("payload_digest").alias("__digest")).distinct()
    origin = records.where("record_type = 'response'").select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
    origin = named.join(origin, ["__page", "__digest"]).groupBy("__page", "__digest").agg(F.max("__bytes").alias("__bytes"))
    out = records.join(origin, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return out.select("page_id", F.when(F.col("record_type") == "revisit", F.col("__bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
