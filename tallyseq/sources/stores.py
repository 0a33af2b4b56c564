"""Byte ranges of files: opening them on executors, and dealing ranges out as partitions of a data source."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition

SPLIT = 64 << 20
SCHEMES = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")  # those of Arrow's file systems


class Part(InputPartition):
    """A partition that carries its own plan."""

    def __init__(self, value) -> None:  # noqa: ANN001
        self.value = value


def opens(path: str) -> bool:
    """Whether opened() knows the file system of a path."""
    return "://" not in path or path.split(":")[0] in SCHEMES


def placed(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, for reads at any place."""
    fs, at = placed(path)
    return fs.open_input_file(at)


def size_of(path: str) -> int:
    fs, at = placed(path)
    info = fs.get_file_info(at)
    if info.type != pa.fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def qualified(spark: SparkSession, path: str) -> str:
    """The whole path, with its file system. Local ones are file:/..., without a call of the JVM for each."""
    if path.startswith("file:/"):
        return "file:" + os.path.normpath("/" + path[len("file:") :].lstrip("/"))
    if path.startswith("/") and _default(spark).startswith("file:"):
        return "file:" + os.path.normpath(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


_defaults: dict[str, str] = {}


def _default(spark: SparkSession) -> str:
    """The file system of paths that name none."""
    name = spark.sparkContext.applicationId
    if name not in _defaults:
        _defaults[name] = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).toString()
    return _defaults[name]


def local(path: str) -> str | None:
    """The plain path of a qualified local one."""
    return path[len("file:") :] if path.startswith("file:/") else None


def ranges(size: int, split: int) -> list[tuple[int, int]]:
    return [(a, min(a + split, size)) for a in range(0, size, split)] or [(0, 0)]


def on_executors(spark: SparkSession, rows: list[tuple], schema: str, work: Callable[[tuple], tuple], answer: str) -> list[tuple]:
    """``work`` of each row, spread over tasks; rows and answers are plans of byte ranges, one for each range of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in work(row)], names=[c.split()[0] for c in answer.split(", ")])

    given = spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism)))
    return sorted(tuple(r) for r in given.mapInArrow(run, answer).collect())


def newlines(path: str, first: int, end: int) -> int:
    """Lines that end in a byte range; one more where the range ends the file within a line."""
    with opened(path) as f:
        f.seek(first)
        n, last, left = 0, b"\n", end - first
        while left and (data := f.read(min(1 << 20, left))):
            n, last, left = n + data.count(b"\n"), data[-1:], left - len(data)
        return n + (last != b"\n" and f.size() == end)


def line_index(spark: SparkSession, paths: list[str], split: int = SPLIT) -> dict[str, list[tuple[int, int]]]:
    """For each file, (byte, lines that end before it) of its ranges, and of its end."""
    rows = [(p, a, b) for p in dict.fromkeys(paths) for a, b in ranges(size_of(p), split)]
    counted = on_executors(spark, rows, "path string, first long, end long", lambda r: (*r, newlines(*r)), "path string, first long, end long, held long")
    out: dict[str, list[tuple[int, int]]] = {}
    for path, first, end, held in counted:
        marks = out.setdefault(path, [(0, 0)])
        marks.append((end, marks[-1][1] + held))
    return out


def place_of_line(marks: list[tuple[int, int]], line: int) -> tuple[int, int]:
    """(byte, lines to pass from there) of a line's beginning."""
    at = max((m for m in marks if m[1] < line), default=(0, 0)) if line else (0, 0)
    return at[0], line - at[1]
