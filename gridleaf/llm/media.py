"""Media columns as content-defined chunks.

A text's UTF-8 bytes, with zero bytes up to a positive multiple of 64, are a
payload of 8-bit samples. A rolling gear hash cuts it; the chunks are stored
once each under their digest, and a medium is an ordered chunk list. Both are
written. Reading joins the lists with the chunk store, puts the samples
together in order and verifies the digest of each chunk. A medium's stored form
is a header, its chunk list and its chunks as they lie in the store; its size
and digest are taken from the bytes read back.

Each stored chunk is compressed by itself, so a medium's stored form follows
from its text alone, whatever else its table holds. Equal texts are one medium,
so groups of copies are read once; a chunk of many media is dealt over several
tasks, each with a copy of it.

Defined results: null texts are empty texts, whose payload is 64 zero bytes;
very long texts are cut whole, a medium being put together in one task; ties of
equal chunks are one chunk; rows are independent, so repeated rows repeat their
result; empty tables give empty results; other columns are ignored, whatever
their names. A chunk that fails its digest fails the job.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, deleted, map_batches, shared_dir, written

UNIT, MAGIC = 64, b"GLCD"
LEAST, MOST, MASK = 1024, 32768, (1 << 12) - 1
GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
#: Places of one chunk beyond which they are dealt over tasks, and the keys they are dealt over.
HOT, SALTS = 10_000, 64


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text, and their number before padding."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks: where the gear hash of the last 32 bytes has its
    low bits zero, no chunk being shorter than LEAST (but the last) or longer
    than MOST."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for by in (1, 2, 4, 8, 16):
        h[by:] += h[:-by] << np.uint32(by)
    spots = np.flatnonzero((h >> np.uint32(13)) & np.uint32(MASK) == 0) + 1
    ends, at = [], 0
    for spot in [*spots.tolist(), n]:
        while spot - at > MOST:
            at += MOST
            ends.append(at)
        if spot - at >= LEAST or spot == n:
            ends.append(spot)
            at = spot
    return ends if ends[-1] == n else [*ends, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True) if b > a]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def container(stored: list[tuple[bytes, bytes]], n_bytes: int) -> bytes:
    """A medium's file form: a header, the list of its chunks (digest, stored
    size), and the stored chunks (digest, compressed samples) as they lie in the store."""
    table = b"".join(sign + struct.pack("<I", len(z)) for sign, z in stored)
    return MAGIC + struct.pack("<QI", n_bytes, len(stored)) + table + b"".join(z for _, z in stored)


def opened(media: bytes) -> tuple[bytes, int]:
    """The payload of a file form, every chunk verified, and its unpadded length."""
    if media[:4] != MAGIC:
        raise ValueError("not a chunked medium")
    n_bytes, n = struct.unpack_from("<QI", media, 4)
    plain = zstandard.ZstdDecompressor()
    at, out = 16 + 20 * n, []
    for i in range(n):
        sign, size = struct.unpack_from("<16sI", media, 16 + 20 * i)
        out.append(verified(plain, sign, media[at : at + size]))
        at += size
    return b"".join(out), n_bytes


def verified(plain: zstandard.ZstdDecompressor, sign: bytes, z: bytes) -> bytes:
    try:
        chunk = plain.decompress(z)
    except zstandard.ZstdError as e:
        raise ValueError("a chunk cannot be read") from e
    if digest(chunk) != sign:
        raise ValueError("a chunk fails its digest")
    return chunk


def feature(samples: bytes) -> str:
    """Whole-number statistics of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    value = np.arange(256)
    p = counts[counts > 0] / len(samples)
    return f"sum={int(counts @ value)};energy={int(counts @ value**2)};levels={int((counts > 0).sum())};entropy={-float(p @ np.log2(p)):.6f}"


def listed(docs: DataFrame) -> DataFrame:
    """doc_id, media_id, n_bytes and the ordered chunk list (digests) of each row."""

    def make():
        def work(x):
            out = {"doc_id": x["doc_id"], "media_id": [], "n_bytes": [], "list": []}
            for text in x["text"]:
                data, n = payload(text)
                out["media_id"].append(digest(struct.pack("<Q", n) + data))
                out["n_bytes"].append(n)
                out["list"].append([digest(c) for c in chunks(data)])
            return out

        return work

    return map_batches(docs.select("doc_id", "text"), "doc_id long, media_id binary, n_bytes long, list array<binary>", make)


def stored(docs: DataFrame) -> DataFrame:
    """The chunk store: digest and compressed samples, each chunk once."""

    def make():
        press, seen = zstandard.ZstdCompressor(level=9), set()

        def work(x):
            out = {"digest": [], "z": []}
            for text in x["text"]:
                for c in chunks(payload(text)[0]):
                    if (sign := digest(c)) not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(sign)
                        out["digest"].append(sign)
                        out["z"].append(press.compress(c))
            return out

        return work

    return map_batches(docs.select("text"), "digest binary, z binary", make).dropDuplicates(["digest"])


def met(places: DataFrame, store: DataFrame, hot: DataFrame) -> DataFrame:
    """places with their stored chunks; those of hot chunks (digest) by a salt,
    with a copy of the chunk for each."""
    salts = hot.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rare = places.join(hot, "digest", "left_anti").join(store, "digest")
    often = places.join(hot, "digest", "left_semi").withColumn("salt", F.pmod(F.xxhash64("media_id", "at"), F.lit(SALTS)).cast("int"))
    return rare.unionByName(often.join(store.join(salts, "digest"), ["digest", "salt"]).drop("salt"))


def rebuilt(lists: DataFrame, store: DataFrame, keep_media: bool = False) -> DataFrame:
    """media_id with the digests of each medium (media_id, n_bytes, list) as
    read back from the store; with keep_media its file form too."""
    places = lists.select("media_id", "n_bytes", F.size("list").alias("k"), F.posexplode("list").alias("at", "digest"))
    part = F.struct("at", "digest", "z")
    # A medium of one chunk is whole where its chunk is; only the others' chunks move on to meet.
    hot = written(places.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("digest"), "media-hot", keep=True)
    some = (lambda rows: rows.join(store, "digest")) if hot.isEmpty() else (lambda rows: met(rows, store, hot))
    single = some(places.where("k = 1")).select("media_id", "n_bytes", F.array(part).alias("parts"), F.lit(1).cast("long").alias("n"))
    gathered = some(places.where("k > 1")).groupBy("media_id").agg(F.first("n_bytes").alias("n_bytes"), F.collect_list(part).alias("parts"), F.count("*").alias("n"))
    gathered = single.unionByName(gathered)

    def make():
        plain = zstandard.ZstdDecompressor()

        def work(x):
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")
            out = {"media_id": x["media_id"], "n_chunks": x["n"], **{c: [] for c in names}}
            for n_bytes, parts in zip(x["n_bytes"], x["parts"], strict=True):
                found = [(p["digest"], p["z"]) for p in sorted(parts, key=lambda p: p["at"])]
                data = b"".join(verified(plain, sign, z) for sign, z in found)
                media = container(found, n_bytes)
                values = (len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).digest(), feature(data), media if keep_media else None)
                for c, v in zip(names, values, strict=True):
                    out[c].append(v)
            return out

        return work

    return map_batches(gathered, "media_id binary, n_chunks long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, media binary", make)


def written_store(docs: DataFrame) -> tuple[DataFrame, str]:
    """The chunk store as a bucketed table of the shared folder, and its name:
    a join on digest reads it where it lies, without moving it again."""
    spark = docs.sparkSession
    name, path = f"chunks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    deleted(spark, path, at_exit=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored(docs).write.bucketBy(n, "digest").option("path", path).format("parquet").saveAsTable(name)
    collected(spark)
    return spark.table(name), name


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_chunks (and media) of each row of docs, all read
    from the written chunk lists and chunk store."""
    spark = docs.sparkSession
    heads = written(listed(docs), "media-lists", keep=True)
    lists = heads.groupBy("media_id").agg(F.first("n_bytes").alias("n_bytes"), F.first("list").alias("list"))
    store, name = written_store(docs)
    try:
        found = written(rebuilt(lists, store, keep_media), "media-found", keep=True)
    finally:
        spark.sql(f"DROP TABLE {name}")
    if not keep_media:
        found = found.drop("media")
    out = heads.select("doc_id", "media_id", "n_bytes").join(found, "media_id").drop("media_id")
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})
