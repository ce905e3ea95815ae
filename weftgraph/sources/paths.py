"""Files by Hadoop's file systems: what exists, can be read, and lies below a folder."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import SparkSession


class Found(NamedTuple):
    path: str
    size: int
    modified: str


def system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def plain(path: str) -> str:
    """A local path without its scheme; other paths as they are."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def state(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a file exists, and whether it can be read."""
    p, fs = system(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        return False, False
    try:
        fs.open(p).close()
    except Exception:  # whatever the file system raises, the file can't be read
        return True, False
    return True, True


#: A file's status as Hadoop writes it.
_STATUS = re.compile(r"\{path=(.*?); isDirectory=false; length=(\d+);.*?modification_time=(\d+);")


def below(spark: SparkSession, folder: str) -> list[Found]:
    """All files below a folder, in order of their paths; none if there is no such folder. One call for all of them."""
    p, fs = system(spark, folder)
    if not fs.exists(p):
        return []
    listed = spark._jvm.org.apache.hadoop.util.functional.RemoteIterators.toList(fs.listFiles(p, True)).toString()
    when = lambda ms: datetime.fromtimestamp(int(ms) / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S")
    return sorted(Found(plain(path), int(size), when(ms)) for path, size, ms in _STATUS.findall(listed))


def text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, such as a project's; None if there is none."""
    p, fs = system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8-sig", "replace")
    finally:
        stream.close()
