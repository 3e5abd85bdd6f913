"""Small files through the file system of the cluster, whichever that is."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

#: A text that is being replaced stands under its name with this end until it has its own name.
NEXT = ".next"


def _open(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_text(spark: SparkSession, name: str) -> str | None:
    """The whole of a small text file of `write_text`, or None where there is none."""
    for place in (name, name + NEXT):
        try:
            row = spark.read.text(place, wholetext=True).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return row[0] if row else None
    return None


def first_line(spark: SparkSession, name: str, chunk: int = 4096) -> bytes:
    """The bytes of a file up to its first line feed (two more, as a line feed can be wider), or the whole file."""
    system, path = _open(spark, name)
    stream = system.open(path)
    try:
        data = b""
        while b"\n" not in data[:-2]:
            more = bytes(stream.readNBytes(chunk))
            if not more:
                return data
            data += more
        return data[: data.index(b"\n") + 3]
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Replaces a small text file as a whole: it is written under another name first and then renamed.

    Who reads it in between, or after a crash, finds the former text or the new one, never a part.
    """
    system, path = _open(spark, name)
    new, temporary = (_open(spark, name + end)[1] for end in (NEXT, f".{uuid.uuid4().hex}"))
    out = system.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(new, False)
    _rename(system, temporary, new)
    system.delete(path, False)
    _rename(system, new, path)


def _rename(system, source, target) -> None:
    if not system.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def exists(spark: SparkSession, name: str) -> bool:
    system, path = _open(spark, name)
    return system.exists(path)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to a place and deletes what was there; done again after a crash it has the same result."""
    system, path = _open(spark, target)
    new = _open(spark, source)[1]
    if system.exists(new):
        system.delete(path, True)
        system.mkdirs(path.getParent())
        _rename(system, new, path)


def remove_text(spark: SparkSession, name: str) -> None:
    remove(spark, name + NEXT)
    remove(spark, name)


def remove(spark: SparkSession, name: str) -> None:
    system, path = _open(spark, name)
    system.delete(path, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern; none where the folder is missing."""
    system, path = _open(spark, pattern)
    return [status.getPath().toString() for status in system.globStatus(path) or ()]
