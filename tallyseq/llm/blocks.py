"""Blocks: documents of one input batch in one row, and word or window lists dealt out by hash.

Row-wise joins of every word of a corpus would shuffle many times its size. A block instead
carries its documents once, compressed, and asks each shard once about its distinct keys; Spark
deals the requests by shard and the answers, with the documents, by block. A block's size is
bounded by BLOCK_CHARS (or one document), a shard's share by the number of shards, which follows the input. A
frequent key comes at most once from each block, so no shard is hot.

Rows are (block long, shard int, data binary): shard -1 for the documents, others for requests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000
ROWS = "block long, shard int, data binary"
FIELDS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def widen(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def put(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one: integers by byte planes, which compress well, then zstandard."""
    parts = []
    for a in arrays:
        if isinstance(a, bytes):
            kind, raw = b"b", a
        else:
            kind = {"uint8": b"1", "uint32": b"4", "uint64": b"8", "int64": b"l"}[a.dtype.name]
            raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        body = squeeze(raw)
        parts.append(kind + len(body).to_bytes(8, "little") + body)
    return b"".join(parts)


def get(data: bytes) -> list:
    """What put() was given."""
    out, at = [], 0
    while at < len(data):
        kind, n = data[at : at + 1], int.from_bytes(data[at + 1 : at + 9], "little")
        raw = widen(data[at + 9 : at + 9 + n])
        at += 9 + n
        if kind == b"b":
            out.append(raw)
        else:
            dtype = np.dtype({b"1": np.uint8, b"4": np.uint32, b"8": np.uint64, b"l": np.int64}[kind])
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel())
    return out


def ids_of(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, 0 for null, and which are known."""
    return np.array([0 if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8)


def name(body: bytes) -> int:
    """A block is named by its content, so that a task that runs again gives the same names."""
    return int(np.frombuffer(hashlib.blake2b(body, digest_size=8).digest(), np.int64)[0])


def batched(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str], dict]]:
    """Runs of documents of at most ``limit`` characters, one document at least: doc_ids, texts, other columns."""
    ids, texts, more, size = [], [], {}, 0
    for b in batches:
        others = [c for c in b.schema.names if c not in ("doc_id", "text")]
        extra = {c: b.column(c).to_pylist() for c in others}
        for k, (i, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)):
            t = t.as_py() or ""
            if texts and size + len(t) > limit:
                yield ids, texts, more
                ids, texts, more, size = [], [], {}, 0
            ids.append(i), texts.append(t)
            for c in others:
                more.setdefault(c, []).append(extra[c][k])
            size += len(t)
    if texts:
        yield ids, texts, more


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(FIELDS.names, r, strict=True)) for r in rows], FIELDS)


def deal(block: int, keys: np.ndarray, shards: int, pack: Callable[[np.ndarray], bytes]) -> list[tuple]:
    """One request row for each shard that has some of ``keys``; ``pack`` gets their indexes, in order."""
    of = (keys % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)  # short numbers are sorted by their digits
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(shards + 1))
    return [(block, s, pack(order[edges[s] : edges[s + 1]])) for s in range(shards) if edges[s] < edges[s + 1]]


def shards_for(docs: DataFrame, size: int = 25_000_000) -> int:
    """One shard for each ``size`` bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, -(-total // size))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs [starts, starts + lengths), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def answered_rows(requests: DataFrame, answer: Callable[[pa.Table], pa.Table], shards: int, schema: str = ROWS) -> DataFrame:
    """Deals the requests by shard, to as many partitions as there are shards; ``answer`` gets all rows of a shard."""
    return requests.repartition(shards, "shard").groupBy("shard").applyInArrow(answer, schema)


def answered(requests: DataFrame, answer: Callable[[list[bytes]], list[bytes]], shards: int) -> DataFrame:
    """The same, where ``answer`` gets the data of all blocks of a shard and gives as many answers."""

    def run(table: pa.Table) -> pa.Table:
        data = answer([x.as_py() for x in table.column("data")])
        return pa.table([table.column("block"), table.column("shard"), pa.array(data, pa.binary())], schema=FIELDS)

    return answered_rows(requests, run, shards)


def rejoined(bodies: DataFrame, answers: DataFrame, finish: Callable[[bytes, list[bytes]], pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
    """Deals documents and answers by block; ``finish`` gets a block's documents and its answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by_shard = dict(zip(right.column("shard").to_pylist(), right.column("data"), strict=True))
        out = [finish(body.as_py(), [x.as_py() for x in by_shard.values()]) for body in left.column("data")]
        return pa.concat_tables(out) if out else empty.empty_table()

    return bodies.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
