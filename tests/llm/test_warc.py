"""op13: archives written and read back, broken ones, and its defined results."""

import gzip
import hashlib
import io
import uuid

import oracle
import pytest

from gridleaf.llm import queries, warc
from gridleaf.llm.common import shared_dir

BIG = "".join(f"<p>é{i}🙂</p>\r\n\r\nWARC/1.1\r\n" for i in range(30_000))
PAGES = [
    (1, "http://a.example/ü x\n", "<p>" + "a" * 200),
    (2, None, BIG),
    (3, "u", None),
    (4, "u", ""),
    (5, "u", "short"),
    (6, "u", "short"),
    (7, "u", "<p>" + "a" * 200),
    (8, "u", BIG),
    (8, "u", BIG),
    (2, "u", BIG),
    (None, "u", "<p>" + "a" * 200),
    (None, "u", "b" * 100),
    (None, "u", "b" * 100),
    (9, "u", "c" * 99),
    (10, "u", "c" * 99),
]
SCHEMA = "page_id long, url string, html string"


def wanted(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if h == html and p is not None]
        again = len(data) >= 100 and same and (i is None or i > min(same))
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, packed):
    df = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.round_trip(df, packed=packed).collect()), key=repr) == wanted(PAGES)


def test_oversized_payloads_are_rows_of_chunks(spark):
    df = spark.createDataFrame(PAGES[:2], SCHEMA).coalesce(1)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    chunks = warc.page_chunks(df, size=1000)
    archives = warc.write_archives(chunks, folder, size=1)
    assert archives.count() == 2 and sorted(r.records for r in archives.collect()) == [1, 1]
    got = warc.read_archives(archives, folder, size=777).where("page_id = '2'").orderBy("chunk_no").collect()
    data, sha = b"", hashlib.sha256()
    for k, r in enumerate(got):
        data += r.data
        sha.update(r.data)
        assert (r.chunk_no, len(r.data) <= 777, r.bytes_so_far, r.sha256_so_far, r.is_last) == (k, True, len(data), sha.hexdigest(), k == len(got) - 1)
    assert data == BIG.encode() and len(got) > 500


def test_packed_archives_are_members_of_one_record(spark):
    df = spark.createDataFrame(PAGES[:1], SCHEMA).coalesce(1)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = warc.write_archives(warc.page_chunks(df), folder).first().path
    raw = open(path, "rb").read()
    assert raw.count(b"\x1f\x8b\x08") >= 2
    text = gzip.decompress(raw).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\n" in text
    assert "WARC-Target-URI: http://a.example/%C3%BC%20x%0A\r\n" in text


def test_wrong_chunks_fail_the_job(spark):
    df = spark.createDataFrame(PAGES[:2], SCHEMA).coalesce(1)
    chunks = warc.page_chunks(df, size=1000)
    for broken in (chunks.where("page_id <> '2' OR chunk_no <> 3"), chunks.where("page_id <> '2' OR chunk_no < 9"), chunks.where("chunk_no > 0")):
        with pytest.raises(Exception, match="page"):
            warc.write_archives(broken, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def test_broken_archives_are_told(spark):
    df = spark.createDataFrame(PAGES[:1], SCHEMA).coalesce(1)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    raw = open(warc.write_archives(warc.page_chunks(df), folder, packed=False).first().path, "rb").read()
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(raw))] == ["1"]
    for bad in (raw.replace(b"aaaa", b"aaab", 1), raw[:-50], raw[:-2], b"x" + raw):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_text_ids_clashes_and_empty_tables(spark):
    rows = [("ü/>\r\n", "u", "x" * 100), ("a b", "u", "x" * 100), ("", "u", "")]
    names = "page_id string, url string, html string, data string, chunk_no string, n string, salt string, first string, again string, refers_to string, payload_digest string"
    df = spark.createDataFrame([(*r, *["v"] * 8) for r in rows], names)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {"ü/>\r\n": ("revisit", "a b"), "a b": ("response", None), "": ("response", None)}
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, data):
    assert oracle.compare(queries.QUERIES["op13_warc"](spark, data), oracle.connect(data), warc.ORACLE_SQL) == ""
