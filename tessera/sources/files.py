"""Files through Hadoop's file systems, so every path that Spark reads works here."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getClass().getSimpleName() in ("LocalFileSystem", "ProxyLocalFileSystem"):
        system = system.getRaw()  # without checksum files, which would go stale when others write the file
    return system, where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file."""
    system, where = _at(spark, path)
    return system.getFileStatus(where).getLen()


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file (of a folder: of its first data file)."""
    found = data_files(spark, path)
    if not found:
        return b""
    system, where = _at(spark, found[0])
    stream = system.open(where)
    try:
        size = min(size, system.getFileStatus(where).getLen())
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The file, or the data files of a folder in the order of names."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return []
    if not system.getFileStatus(where).isDirectory():
        return [path]
    names = [s.getPath().toString() for s in system.listStatus(where) if s.isFile()]
    return sorted(n for n in names if n.rpartition("/")[2][0] not in "._")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole file; for single values, not for tables."""
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Writes a file beside its place, then moves it there, making folders as needed."""
    system, where = _at(spark, path)
    if where.getParent() is not None:
        system.mkdirs(where.getParent())
    beside, hidden = _at(spark, f"{path.rpartition('/')[0] or '.'}/.{uuid.uuid4().hex}.tmp")
    stream = system.create(hidden, True)
    try:
        for part in parts:
            stream.write(bytearray(part))
    except BaseException:
        stream.close()
        beside.delete(hidden, False)
        raise
    stream.close()
    swap(spark, hidden.toString(), path)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Moves what was written beside it into place; the old content goes only then."""
    system, where = _at(spark, path)
    _, fresh = _at(spark, new)
    _, old = _at(spark, f"{path.rpartition('/')[0] or '.'}/.{uuid.uuid4().hex}.old")
    had = system.exists(where)
    if had and not system.rename(where, old):
        raise OSError(f"cannot replace {path}")
    if not system.rename(fresh, where):
        if had:
            system.rename(old, where)
        raise OSError(f"cannot write {path}")
    if had:
        system.delete(old, True)


def write_frame(spark: SparkSession, frame: DataFrame, path: str, kind: str, one_file: bool, **options: object) -> None:
    """Writes a table beside its place, then swaps it in, so a table may be overwritten by what was read from it.

    It is a folder of one file for each task. With ``one_file`` the path is a single file: all tasks write CSV, whose files
    are then joined; a file in another format, or encoding, gets all rows through a shuffle to the one task that writes it.
    What comes before the writing keeps its tasks in any case.
    """
    beside = f"{path.rpartition('/')[0] or '.'}/.{uuid.uuid4().hex}.tmp"
    if not one_file:
        frame.write.options(**options).format(kind).save(beside)
        swap(spark, beside, path)
        return
    try:
        if kind == "csv" and str(options.get("encoding", "utf-8")).lower() in ("utf-8", "utf8", "us-ascii", "iso-8859-1"):
            header = str(options.get("header", "false")).lower() == "true"
            bare = {**options, "header": "false"}
            frame.write.options(**bare).csv(f"{beside}/rows")
            parts = data_files(spark, f"{beside}/rows")
            if header:
                names = spark.range(1).select(*(F.lit(c).alias(c) for c in frame.columns))
                names.coalesce(1).write.options(**bare).csv(f"{beside}/header")
                parts = data_files(spark, f"{beside}/header") + parts
            join_files(spark, parts, path)
        else:
            frame.repartition(1).write.options(**options).format(kind).save(beside)
            parts = data_files(spark, beside)
            if not parts:
                raise OSError(f"nothing was written for {path}")
            swap(spark, parts[0], path)
    finally:
        delete(spark, beside)


def join_files(spark: SparkSession, parts: list[str], path: str, start: bytes = b"", end: bytes = b"", separator: int = 0) -> None:
    """Joins files in their order, the last one without its last ``separator`` bytes, between a start and an end. The bytes
    go from stream to stream."""
    sizes = {p: (found := _at(spark, p))[0].getFileStatus(found[1]).getLen() for p in parts}
    filled = [p for p in parts if sizes[p]]
    system, where = _at(spark, path)
    if where.getParent() is not None:
        system.mkdirs(where.getParent())
    beside, hidden = _at(spark, f"{path.rpartition('/')[0] or '.'}/.{uuid.uuid4().hex}.tmp")
    out = system.create(hidden, True)
    try:
        out.write(bytearray(start))
        for p in filled:
            own, at = _at(spark, p)
            stream = own.open(at)
            try:
                wanted = sizes[p] - (separator if p == filled[-1] else 0)
                spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, wanted)
            finally:
                stream.close()
        out.write(bytearray(end))
    except BaseException:
        out.close()
        beside.delete(hidden, False)
        raise
    out.close()
    swap(spark, hidden.toString(), path)
