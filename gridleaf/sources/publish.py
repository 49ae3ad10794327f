"""Sinks that appear as a whole or not at all.

A job writes to a hidden folder beside its target. Only when it has ended does
the folder take the target's name: the old one is put aside by a rename, the new
one renamed into place, and the old one deleted. A job that fails leaves the old
rows as they were. Should the driver die between the two renames, the next
reader or writer of the target puts the old folder back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return jvm, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def published(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write(folder) fills a hidden folder, which then replaces path."""
    recovered(spark, path)
    jvm, files, target = _at(spark, path)
    parent, name, run = target.getParent(), target.getName(), uuid.uuid4().hex
    new, old = (jvm.org.apache.hadoop.fs.Path(parent, f".{name}.{kind}-{run}") for kind in ("new", "old"))
    try:
        write(new.toString())
        if files.exists(target):
            _moved(files, target, old)
        _moved(files, new, target)
    except BaseException:
        recovered(spark, path)
        raise
    finally:
        files.delete(new, True)
    files.delete(old, True)


def _moved(files, a, b) -> None:
    if not files.rename(a, b):
        raise OSError(f"{a.toString()} could not be renamed to {b.toString()}")


def recovered(spark: SparkSession, path: str) -> str:
    """path, put back if a writer died after it had put the old rows aside."""
    jvm, files, target = _at(spark, path)
    parent = target.getParent()
    if not files.exists(target) and files.exists(parent):
        aside = files.globStatus(jvm.org.apache.hadoop.fs.Path(parent, f".{target.getName()}.old-*"))
        if aside:
            _moved(files, max(aside, key=lambda s: s.getModificationTime()).getPath(), target)
    return path
