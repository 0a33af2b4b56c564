"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text falls apart where no piece of the vocabulary could join its characters, and each part is merged by itself: its symbols form a linked
list, a heap holds the adjacent pairs that are pieces, and the pair of lowest rank (the leftmost of equals) is merged until the heap is
empty. The count is the number of symbols at first less the merges; a character outside the vocabulary counts its UTF-8 bytes.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in a model file
KEPT_WORDS, KEPT_LENGTH = 500_000, 64
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message: integers, raw bytes of fixed fields, bytes of the others."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Merger:
    """Counts for one model file of the sentencepiece library (byte-pair kind, with or without byte fallback)."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.normalize = SentencePieceProcessor(model_file=path).normalize
        with open(path, "rb") as f:
            pieces = [dict(fields(value)) for number, value in fields(f.read()) if number == 1]
        kinds = {p.get(3, NORMAL) for p in pieces}
        if kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("pieces that are user-defined or unused are not supported")
        self.fallback = BYTE in kinds
        self.rank = {p[1].decode(): -struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces if p.get(3, NORMAL) == NORMAL}
        self.letters = frozenset(p for p in self.rank if len(p) == 1)
        # a cut before a space is safe where no piece has a space after another character
        cuts = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cuts else "(?s:.+)").findall
        self.known: dict[str, int] = {}

    def merged(self, part: str) -> int:
        """Tokens of a part of a normalised text."""
        get, n = self.rank.get, len(part)
        heap = [(k, i, i + 2) for i in range(n - 1) if (k := get(part[i : i + 2])) is not None]
        heapify(heap)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after = end[:]
        merges = 0
        while heap:
            _, left, stop = heappop(heap)
            if not end[left] or (right := after[left]) >= n or end[right] != stop:  # one of the two has been merged since
                continue
            end[left], end[right] = stop, 0
            follow = after[left] = after[right]
            merges += 1
            if follow < n:
                before[follow] = left
                if (k := get(part[left : end[follow]])) is not None:
                    heappush(heap, (k, left, end[follow]))
            if (first := before[left]) >= 0 and (k := get(part[first:stop])) is not None:
                heappush(heap, (k, first, stop))
        total = n - merges
        if self.fallback and not self.letters.issuperset(part):
            total += sum(len(c.encode()) - 1 for i, c in enumerate(part) if end[i] == i + 1 and c not in self.letters)
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text. Answers for short parts are kept, as words come again; what is kept is bounded."""
        total = 0
        for part, times in Counter(self.parts(self.normalize(text))).items():
            have = self.known.get(part)
            if have is None:
                have = self.merged(part)
                if len(part) <= KEPT_LENGTH:
                    if len(self.known) >= KEPT_WORDS:
                        self.known.clear()
                    self.known[part] = have
            total += have * times
        return total


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path``: a byte-pair model of the sentencepiece library, present on every executor; n_tokens is the length of the library's encode()
    without begin or end, special strings in a text being ordinary text. Rows stay where they are: no shuffle. A part without
    spaces of n characters takes n log n steps, however long. Null or empty text: 0 bytes and tokens. A null doc_id stays null; repeated rows
    each get their answer; empty table: no rows; other columns are ignored. Pairs of equal rank: the leftmost goes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path).count
        for b in batches:
            n = [count(t.as_py()) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], schema=FIELDS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
