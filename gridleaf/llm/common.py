"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one of this machine where it is unset and Spark runs locally."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="gridleaf-"))
    return "file://" + _LOCAL[0]


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go to a folder of the shared one that is deleted at the end."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        deleted(spark, path)


def deleted(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder of the shared one, now or when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(at) if at_exit else files.delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage
    ends there, and a lost executor costs no recomputation of what came before.
    With keep, or outside a scratch folder, it stays until the driver ends."""
    spark = df.sparkSession
    folder = None if keep else _FOLDER.get()
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if folder is None:
        deleted(spark, path, at_exit=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written table that is no longer read."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        deleted(df.sparkSession, path)


def collected(spark: SparkSession) -> None:
    """Lets go of the shuffle files of what has ended, which else stay until the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def hash_ordered(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """At most rows of df, the first in the order of the columns' hash. Where df
    has more, a bound on the hash keeps few more than those, so that not every
    task sends as many to the driver; df is read twice."""
    n, h = df.count(), F.xxhash64(*order)
    most = rows + 6 * rows**0.5 + 10
    if n > most:
        df = df.where(h < int(-(2**63) + 2**64 * most / n))
    return df.orderBy(h, *order).limit(rows)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], size: int = 2 << 20) -> DataFrame:
    """mapInArrow over columns as Python lists. make() runs once in each task
    and returns the function from columns to columns of any length. Batches are
    worked on in slices of few rows and of size bytes (but one row at least), so
    that a slice's Python objects stay few."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at, n in slices(batch, size=size):
                part = batch.slice(at, n)
                got = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(start, rows) of a batch's slices."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(total), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - at, batch.num_rows - at))
        yield at, n
        at += n


#: Words that are remembered at most, and bytes of a word that is.
REMEMBERED, SHORT = 400_000, 256


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > SHORT:
            return self.hashed(word)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = self.hashed(word)
        return value

    @staticmethod
    def hashed(word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_OF_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64)
_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, remembered."""
    if len(_POWERS[0]) < n:
        size = n + n // 4
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs without ASCII white space start and end in bytes."""
    step = np.diff((~_WHITE[data]).view(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, by sums of powers: equal stretches have equal ones wherever they stand."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * power[:-1], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words, in order; of the whole sequence where it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i]
    return mixed(total)
