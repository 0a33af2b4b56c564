"""Input planning on the driver: which FASTQ files make up which sample and lane."""

from __future__ import annotations

import os
import re
from itertools import groupby

from pyspark.sql import SparkSession

from tallyseq.sources import stores

LANE = re.compile(r"_L[0-9][^_]*$")


def _file_system(path: str):  # noqa: ANN202
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def find(directory: str, pattern: str) -> list[str]:
    """Files under a directory of any store that Spark reads whose names contain ``pattern``, sorted by path. Local ones are given as plain paths."""
    if plain := stores.local(stores.qualified(SparkSession.active(), directory)):
        return sorted(os.path.join(d, f) for d, _, names in os.walk(plain) for f in names if pattern in f and not f.endswith(".crc"))
    fs, where = _file_system(directory)
    found, every = [], fs.listFiles(where, True)
    while every.hasNext():
        path = every.next().getPath()
        if pattern in path.getName():
            found.append(path.toString())
    return sorted(found)


def size_of(path: str) -> int:
    """Bytes of a file, 0 where there is none."""
    if plain := stores.local(stores.qualified(SparkSession.active(), path)):
        return os.path.getsize(plain) if os.path.exists(plain) else 0
    fs, where = _file_system(path)
    return fs.getFileStatus(where).getLen() if fs.exists(where) else 0


def listed(option: str) -> list[str]:
    """Paths of a comma list."""
    return [p for p in option.split(",") if p]


def check_counts(r1: list[str], r2: list[str], r3: list[str]) -> None:
    if not r1 or any(x and len(x) != len(r1) for x in (r2, r3)) or not (r2 or r3):
        raise ValueError("R1 files need as many R2 or R3 files")


def sample_of(path: str, pattern: str) -> str:
    """Name before the pattern, without a lane suffix."""
    return LANE.sub("", os.path.basename(path).split(pattern)[0].rstrip("_") if pattern in os.path.basename(path) else os.path.basename(path))


def _sets(sample: str, r1: list[str], r2: list[str], r3: list[str]) -> list[dict]:
    check_counts(r1, r2, r3)
    mates = [(a, r2[i] if r2 else None, r3[i] if r3 else None) for i, a in enumerate(r1)]
    return [{"sample": sample, "r1": a, "r2": b, "r3": c, "bytes": sum(size_of(p) for p in (a, b, c) if p)} for a, b, c in mates]


def numbered(sets: list[dict]) -> list[dict]:
    """Adds lane, from 0 over all file sets of a sample, however often its name comes back."""
    seen: dict[str, int] = {}
    out = []
    for s in sets:
        seen[s["sample"]] = seen.get(s["sample"], -1) + 1
        out.append(s | {"lane": str(seen[s["sample"]])})
    return out


def by_directory(root: str, patterns: tuple[str, str, str] = ("_R1_", "_R2_", "_R3_")) -> list[dict]:
    """One sample for each directory that holds R1 files; directories of one name in different places are one sample."""
    of = lambda p: {d: list(f) for d, f in groupby(find(root, p), os.path.dirname)}
    r1, r2, r3 = map(of, patterns)
    return largest_first([s for d in sorted(r1) for s in _sets(os.path.basename(d), r1[d], r2.get(d, []), r3.get(d, []))])


def by_name(r1: list[str], r2: list[str], r3: list[str], pattern: str = "_R1_", merge_all: bool = False) -> list[dict]:
    """One sample for each name; ``merge_all``: one sample."""
    check_counts(r1, r2, r3)
    names = ["sample"] * len(r1) if merge_all else [sample_of(p, pattern) for p in r1]
    out = []
    for name, run in groupby(range(len(r1)), names.__getitem__):
        at = list(run)
        out += _sets(name, [r1[i] for i in at], [r2[i] for i in at] if r2 else [], [r3[i] for i in at] if r3 else [])
    return largest_first(out)


def largest_first(sets: list[dict]) -> list[dict]:
    """File sets of the sample with most bytes first."""
    size: dict[str, int] = {}
    for s in sets:
        size[s["sample"]] = size.get(s["sample"], 0) + s["bytes"]
    return sorted(numbered(sets), key=lambda s: (-size[s["sample"]], s["sample"], int(s["lane"])))


def library_of(path: str) -> str | None:
    """SC and digits in a file's name, None if there is none."""
    found = re.search("SC[0-9]+", os.path.basename(path))
    return found[0] if found else None
