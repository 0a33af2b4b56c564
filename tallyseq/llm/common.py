"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseq.operators.common import cut

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, odd: np.uint64 = ODD) -> tuple[np.ndarray, np.ndarray]:
    """odd ** i and its inverse modulo 2 ** 64, for i up to ``n``; kept for the process, as long as any that was asked for."""
    have = _powers.get(int(odd))
    if have is None or len(have[0]) <= n:
        up = np.full(n + 1, odd)
        down = np.full(n + 1, np.uint64(pow(int(odd), -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _powers[int(odd)] = (np.cumprod(up), np.cumprod(down))
    return have


def runs_hashed(values: np.ndarray, first: np.ndarray, end: np.ndarray, odd: np.uint64 = ODD) -> np.ndarray:
    """Hash of each run values[first:end]: a polynomial modulo 2 ** 64, from sums over what lies before."""
    up, down = powers(len(values), odd)
    sums = np.append(np.uint64(0), np.cumsum(values * up[: len(values)]))
    return mix64((sums[end] - sums[first]) * down[first])


def word_hashes(texts: list[bytes], chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (run without ASCII white space) of the texts, and the number of words of each text.

    Runs of texts of about ``chunk`` bytes are hashed together.
    """
    hashes, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= chunk):
            size += len(texts[to])
            to += 1
        data = np.frombuffer(b"\n".join([*texts[at:to], b""]), np.uint8)
        space = SPACE[data]
        before = np.append(True, space[:-1])
        first, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        edges = np.cumsum([len(t) + 1 for t in texts[at:to]], dtype=np.int64)
        counts.append(np.diff(np.searchsorted(first, edges), prepend=0))
        hashes.append(runs_hashed(BYTES[data], first, end))
        at = to
    return np.concatenate(hashes), np.concatenate(counts)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus`` (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of plans that nothing refers to any more; its cleaner acts on what the driver's collector finds."""
    spark.sparkContext._jvm.System.gc()


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the (u, v) of one partition as edges (u, smallest id that the partition links it to)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    pairs = [(x, root(x)) for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame, per_part: int = 300_000) -> DataFrame:
    """Connected components of ``edges(a, b)``: union-find inside partitions of about ``per_part`` edges, then alternating large-star and small-star steps.

    Returns (id, component) for each id in an edge between different ids; component
    is the smallest reachable id. A step only takes minima (combined map-side)
    and joins edges with them, so a hub of any degree is no hot group, and the number
    of edges never grows. Stops when a step leaves the edge set unchanged, or when one partition has held all edges.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = state(e)
    while now[0]:
        parts = -(-now[0] // per_part)
        e = e.coalesce(parts).mapInArrow(contracted, "u long, v long")
        if parts == 1:
            break
        e = e.distinct()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, state(e)
        if now == before:
            break
    return cut(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
