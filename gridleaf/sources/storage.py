"""Listing and reading of many files by the executors, through the file systems that Arrow knows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import staged

#: Bytes of contents sent on at once, and of listed files that one task reads.
BATCH, TASK_BYTES = 4 << 20, 64 << 20
KNOWN = ("file", "hdfs", "s3", "gs")
_ENTRIES = "path string, is_dir boolean, size long, mtime long"
_ARROW = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.int64())])


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, as Hadoop writes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


@lru_cache(maxsize=32)
def _system(scheme: str, authority: str) -> tuple[pafs.FileSystem, str]:
    if scheme == "file":
        return pafs.LocalFileSystem(), ""
    files, base = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return files, base.rstrip("/")


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, its own name of a qualified path, what stands before such names in qualified ones)."""
    scheme, authority, rest = re.fullmatch(r"([A-Za-z0-9+.-]+):(?://([^/]*))?(/.*)", path).groups()
    files, base = _system(scheme, authority or "")
    before = f"{scheme}:" + (f"//{authority}" if authority else "")
    return files, base + (re.sub("^/+", "/", rest) if scheme == "file" else rest), before


def known(path: str) -> bool:
    return path.split(":", 1)[0] in (*KNOWN, "s3a")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            files, name, before = opened(folder)
            # Object stores name files from the bucket on, which qualified paths hold as their authority.
            skip = 0 if name.startswith("/") else len(name.split("/", 1)[0])
            found = files.get_file_info(pafs.FileSelector(name, allow_not_found=True))
            yield pa.RecordBatch.from_pydict({
                "path": [before + i.path[skip:] for i in found],
                "is_dir": [i.type == pafs.FileType.Directory for i in found],
                "size": [i.size or 0 for i in found],
                "mtime": [(i.mtime_ns or 0) // 1_000_000 for i in found],
            }, schema=_ARROW)


def listed(spark: SparkSession, roots: Sequence[str], recursive: bool = False) -> DataFrame:
    """path, size, mtime of the files of folders, or of all below them. Folders
    of a level are dealt to tasks; no file's name passes through the driver."""
    level = spark.createDataFrame([(r,) for r in roots], "path string").repartition(len(roots))
    found = []
    while True:
        here = staged(level.mapInArrow(_listed, _ENTRIES), "listing")
        found.append(here.where("NOT is_dir").select("path", "size", "mtime"))
        folders = here.where("is_dir").select("path")
        if not recursive or (n := folders.count()) == 0:
            break
        level = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def read(files: DataFrame) -> DataFrame:
    """files (path, size, ...) with their bytes as content; unreadable ones null. Just these files are opened."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows, size = [], [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    system, name, _ = opened(path)
                    with system.open_input_stream(name, compression=None) as src:
                        body = src.read()
                except OSError:
                    body = None
                held.append(body)
                rows.append(i)
                size += len(body or b"")
                if size >= BATCH:
                    yield _with(batch, rows, held)
                    held, rows, size = [], [], 0
            if rows:
                yield _with(batch, rows, held)

    def _with(batch: pa.RecordBatch, rows: list[int], held: list[bytes | None]) -> pa.RecordBatch:
        part = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*names, "content"])

    from pyspark.sql import types as T

    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES), files.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(int(tasks)).mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))
