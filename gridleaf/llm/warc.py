"""WARC archives of pages, written and read as rows of chunks.

A payload is a sequence of rows of a record's identifier and a chunk number, so
no step after the page's own row holds a whole record. The writer takes the
rows of a partition as they come, keeps a digest of what it has written, and
fails if that differs from the one announced in the record's header. The reader
parses an archive as a stream and yields the same rows, each with the bytes and
the digest up to its end; the last row of a record thus carries the digest of
the whole payload, which must be the announced one.

Of records with equal payloads of 100 bytes or more, that of the smallest page
is a response and the others are revisits without payload; their HTTP header
keeps the length. Equal payloads meet by digest and a salt, so that a payload
of many copies is not one task's, and only ids and digests are shuffled for it.
An archive counts once the task that wrote it has ended: tasks return the paths
they wrote, and what a lost task left behind is in no list.

Defined results: a null payload is an empty one, stored as a response; very long
payloads are written and read in chunks; rows that repeat a page_id are records
each, all responses if their page is the smallest of its payload; a null page_id
counts as the largest, and payloads of null ids only are all responses; empty
tables give no archive and an empty result; null addresses are empty; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import IO, Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, scratch, shared_dir, written

#: Bytes of a payload in one row, of an archive before the next begins, and of rows sent on at once.
CHUNK, ARCHIVE, BATCH = 256 << 10, 1 << 30, 4 << 20
#: Bytes from which equal payloads are stored once, and keys that copies of one payload are dealt over.
LEAST, SALTS = 100, 64
#: Pages have no date of capture.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"

CHUNKS = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, chunk_no long, data binary"
READ = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, chunk_no long, is_last boolean, bytes_so_far long, sha256_so_far string, data binary"
ARCHIVES = "path string, bytes long, records long"


def revisits(pages: DataFrame, ident: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, payload_digest, refers_to of the pages whose payload a smaller page has."""
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(ident).alias("page_id"), F.octet_length(text).alias("n"), F.sha2(text, 256).alias("payload_digest"))
    rows = rows.where(F.col("n") >= least).select("page_id", "payload_digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    parts = rows.groupBy("payload_digest", "salt").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # At most SALTS rows of a payload meet here.
    whole = parts.groupBy("payload_digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    whole = whole.where("n > 1 AND first IS NOT NULL").select("payload_digest", F.explode("salts").alias("salt"), "first")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return rows.join(whole, ["payload_digest", "salt"]).where(later).select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()


def page_chunks(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, size: int = CHUNK) -> DataFrame:
    """The rows of chunks of all records, those of a record in order and together."""
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(ident).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), text.alias("html"), F.sha2(text, 256).alias("payload_digest"))
    # The repeats are a written table, so the planner knows its size: few go to every task, many are joined.
    seen = written(revisits(pages, ident, payload, least), "revisits")
    side = seen.select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), "refers_to", F.lit(True).alias("again"))
    rows = rows.join(side, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    rows = rows.select(F.col("page_id").cast("string"), "url", F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.col("refers_to").cast("string"), F.octet_length("html").cast("long").alias("payload_bytes"), "payload_digest", "html")
    schema = _arrow(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            heads = batch.drop_columns(["html"]).to_pylist()
            for i, head in enumerate(heads):
                body = batch.column("html")[i].as_buffer() if head["record_type"] == "response" else pa.py_buffer(b"")
                for k in range(max(1, -(-body.size // size))):
                    yield from out.add({**head, "chunk_no": k, "data": body.slice(k * size, min(size, body.size - k * size)).to_pybytes()})
        yield from out.rest()

    return rows.mapInArrow(run, CHUNKS)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


class Rows:
    """Collects rows of chunks into batches of few bytes."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.rows: list[dict[str, Any]] = []
        self.size = 0

    def add(self, row: dict[str, Any]) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += len(row.get("data") or b"") + 256
        if self.size >= BATCH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.size = [], 0


def record_id(page: str | None) -> str:
    return f"<urn:x-page:{quote(page or '', safe='')}>" if page is not None else "<urn:x-page>"


def page_of(ident: str) -> str | None:
    name = ident.strip("<>").removeprefix("urn:x-page")
    return unquote(name[1:]) if name.startswith(":") else None


class Archive:
    """One archive file, written record after record."""

    def __init__(self, files: pafs.FileSystem, folder: str, packed: bool) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc" + ".gz" * packed
        self.out, self.packed = files.open_output_stream(self.path, compression=None), packed
        self.bytes = self.records = 0
        self.begin()
        self.put(VERSION + _lines({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": 0}))
        self.end()

    def begin(self) -> None:
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31) if self.packed else None

    def put(self, data: bytes) -> None:
        data = self.zip.compress(data) if self.zip else data
        self.bytes += len(data)
        self.out.write(data)

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        if self.zip:
            tail = self.zip.flush()
            self.bytes += len(tail)
            self.out.write(tail)

    def head(self, row: dict[str, Any]) -> None:
        self.begin()
        said = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        again = row["record_type"] == "revisit"
        fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": record_id(row["page_id"]), "WARC-Date": DATE, "WARC-Target-URI": quote(row["url"], safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Payload-Digest": f"sha256:{row['payload_digest']}"}
        if again:
            fields |= {"WARC-Refers-To": record_id(row["refers_to"]), "WARC-Profile": PROFILE}
        fields |= {"Content-Type": HTTP, "Content-Length": len(said) + (0 if again else row["payload_bytes"])}
        self.put(VERSION + _lines(fields) + said)
        self.records += 1


def _lines(fields: dict[str, Any]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"


def write_archives(chunks: DataFrame, folder: str, packed: bool = True, size: int = ARCHIVE) -> DataFrame:
    """path, bytes, records of the archives that the rows of chunks were written
    to. The rows of a record must come in order and together; a record whose
    bytes are not those announced fails the job. The list is written, as it
    tells which archives count."""
    schema = _arrow(ARCHIVES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        done, now, open_, sha, n = Rows(schema), None, None, None, 0

        def closed() -> None:
            if open_ is not None:
                if n != (open_["payload_bytes"] if open_["record_type"] == "response" else 0) or (n and sha.hexdigest() != open_["payload_digest"]):
                    raise ValueError(f"the chunks of page {open_['page_id']} are not the announced payload")
                now.end()

        def listed() -> Iterator[pa.RecordBatch]:
            now.out.close()
            yield from done.add({"path": now.path, "bytes": now.bytes, "records": now.records})

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    closed()
                    if now is not None and now.bytes >= size:
                        yield from listed()
                        now = None
                    if now is None:
                        files.create_dir(base, recursive=True)
                        now = Archive(files, base, packed)
                    now.head(row)
                    open_, sha, n, last = row, hashlib.sha256(), 0, -1
                elif open_ is None or row["page_id"] != open_["page_id"]:
                    raise ValueError(f"chunk {row['chunk_no']} of page {row['page_id']} comes without its first")
                if row["chunk_no"] != last + 1:
                    raise ValueError(f"chunk {row['chunk_no']} of page {row['page_id']} follows chunk {last}")
                last = row["chunk_no"]
                sha.update(row["data"])
                n += len(row["data"])
                now.put(row["data"])
        closed()
        if now is not None:
            yield from listed()
        yield from done.rest()

    return written(chunks.mapInArrow(run, ARCHIVES), "archives")


def _headers(src: IO[bytes]) -> tuple[dict[str, str], int]:
    """Header lines up to the blank one, and their bytes."""
    out, n = {}, 0
    while True:
        line = src.readline(1 << 16)
        n += len(line)
        if not line.strip():
            return out, n
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()


def read_records(src: IO[bytes], size: int = CHUNK) -> Iterator[dict[str, Any]]:
    """The rows of chunks of an archive's responses and revisits, read as a stream."""
    while line := src.readline(1 << 16):
        if line != VERSION:
            raise ValueError(f"no record begins with {line[:40]!r}")
        head, _ = _headers(src)
        left, kind = int(head["content-length"]), head["warc-type"]
        said: dict[str, str] = {}
        if head.get("content-type") == HTTP:
            status = src.readline(1 << 16)
            said, n = _headers(src)
            left -= len(status) + n
        known = {"page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None}
        known |= {"payload_bytes": int(said.get("content-length", left)), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:")}
        sha, so_far, k = hashlib.sha256(), 0, 0
        while True:
            data = src.read(min(size, left))
            if len(data) < min(size, left):
                raise ValueError(f"the record of page {known['page_id']} is cut short")
            left -= len(data)
            so_far += len(data)
            sha.update(data)
            if kind == "response" and not left and sha.hexdigest() != known["payload_digest"]:
                raise ValueError(f"the payload of page {known['page_id']} is not the announced one")
            if kind in ("response", "revisit"):
                yield {**known, "chunk_no": k, "is_last": not left, "bytes_so_far": so_far, "sha256_so_far": sha.hexdigest(), "data": data}
            k += 1
            if not left:
                break
        if src.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record of page {known['page_id']} does not end")


def read_archives(archives: DataFrame, folder: str, data: bool = True, size: int = CHUNK) -> DataFrame:
    """The rows of chunks of the listed archives, with the bytes and the digest up
    to each; without data, the payloads' bytes are digested and left out."""
    schema = _arrow(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        out = Rows(schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(path, compression=None) as raw:
                    src = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                    for row in read_records(src, size):
                        yield from out.add(row if data else {**row, "data": None})
        yield from out.rest()

    tasks = max(1, archives.count())
    return archives.select("path").repartition(tasks).mapInArrow(run, READ)


def round_trip(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", packed: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each
    page, as they are read back from archives that are written for it."""
    kind = dict(pages.dtypes)[ident]
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    try:
        with scratch(spark):
            archives = write_archives(page_chunks(pages, ident, url, payload), folder, packed)
            last = read_archives(archives, folder, data=False).where("is_last")
            again = F.col("record_type") == "revisit"
            size = F.when(again, F.col("payload_bytes")).otherwise(F.col("bytes_so_far"))
            digest = F.when(again, F.col("payload_digest")).otherwise(F.col("sha256_so_far"))
            out = last.select(F.col("page_id").cast(kind).alias(ident), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
            return written(out, "records", keep=True)
    finally:
        deleted(spark, folder)


ORACLE_SQL = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
first AS (SELECT payload_digest, min(page_id) AS page FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page < page_id THEN page END AS refers_to
FROM sized LEFT JOIN first USING (payload_digest)
"""
