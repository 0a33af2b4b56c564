"""Substring dedup by recompression: locally consistent symbols reveal long repeats, window hashes verify them.

Words are symbols of level 0. The first round names runs of equal words, each further round pairs of neighbours whose left
symbol has bit 0 and whose right symbol has bit 1 of a hash. A name is a hash of what it replaces, so it is the same
all over the corpus without a lookup. Each symbol keeps the stretch of words that its derivation looked at (its
context); in any other place where these words occur, the same symbol arises. A window of words chooses, from the
symbols whose contexts lie inside it, one by a rule that depends on the window's words only, down to level 0, where each
word is its own context. So equal windows always choose equal symbols, and only windows whose symbol several
documents hold can repeat. Their full hashes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm import blocks
from tallyseq.llm.common import ODD, cut, mix64, runs_hashed, word_hashes

BLOCK_CHARS = 3_000_000  # the parse of a block takes some tens of bytes for each of its own
LOOK = 4  # symbols of a level among which a window takes the longest
ODD2 = np.uint64(0x2545F4914F6CDD1D)
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


class Level:
    """Symbols of one level over the words of a block: name, first and last word + 1, context."""

    def __init__(self, name, start, end, low, high) -> None:  # noqa: ANN001
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    def take(self, i: np.ndarray) -> Level:
        return Level(self.name[i], self.start[i], self.end[i], self.low[i], self.high[i])


def runs_named(x: Level, doc: np.ndarray, edges: tuple) -> Level:
    """Each maximal run of equal symbols as one; its context takes in the neighbours that end it."""
    n = len(x.name)
    d = doc[x.start]
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    name = np.where(size > 1, mix64(x.name[first] + size.astype(np.uint64) * ODD), x.name[first])
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    inside_l = (first > 0) & (d[before] == d[first])
    inside_r = (last < n - 1) & (d[after] == d[last])
    # beyond the ends of a document there is nothing to look at: such a context fits no window
    low = np.where(inside_l, x.low[before], edges[0][d[first]] - 1)
    high = np.where(inside_r, x.high[after], edges[1][d[last]] + 1)
    return Level(name, x.start[first], x.end[last], low, high)


def pairs_named(x: Level, doc: np.ndarray, edges: tuple) -> Level:
    """Each pair of a bit-0 and a bit-1 neighbour as one; a symbol left alone has looked at the neighbour that it might have joined."""
    n = len(x.name)
    d = doc[x.start]
    bit = (mix64(x.name ^ ODD2) >> np.uint64(63)).astype(bool)
    follows = np.zeros(n, bool)
    follows[:-1] = d[1:] == d[:-1]
    joins = np.zeros(n, bool)
    joins[:-1] = follows[:-1] & ~bit[:-1] & bit[1:]
    joined = np.zeros(n, bool)
    joined[1:] = joins[:-1]
    nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    led = np.zeros(n, bool)
    led[1:] = follows[:-1]
    high = np.where(joins | ~bit, np.where(follows, x.high[nxt], edges[1][d] + 1), x.high)
    low = np.where(bit & ~joined, np.where(led, x.low[prv], edges[0][d] - 1), x.low)
    name = np.where(joins, mix64(mix64(x.name) + x.name[nxt] * ODD), x.name)
    out = Level(name, x.start, np.where(joins, x.end[nxt], x.end), low, high)
    return out.take(np.flatnonzero(~joined))


def windows_of(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of ``width`` words of one document, and its document."""
    starts = np.cumsum(lengths) - lengths
    many = np.maximum(lengths - width + 1, 0)
    return blocks.ragged(starts, many), np.repeat(np.arange(len(lengths)), many)


def anchors(h: np.ndarray, lengths: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Name of the symbol that each window chooses."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    edges, at = (ends - lengths, ends), np.arange(len(h))
    levels = [Level(mix64(h), at, at + 1, at, at + 1)]
    if len(h):
        levels.append(runs_named(levels[0], doc, edges))
        for _ in range(rounds):
            levels.append(pairs_named(levels[-1], doc, edges))
    p, _ = windows_of(lengths, width)
    out = np.zeros(len(p), np.uint64)
    open_ = np.arange(len(p))
    for x in reversed(levels):
        if not len(open_):
            break
        q = p[open_]
        first = np.searchsorted(x.low, q)
        best, length = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for k in range(LOOK):
            i = np.minimum(first + k, len(x.name) - 1)
            size = np.where((first + k < len(x.name)) & (x.high[i] <= q + width), x.end[i] - x.start[i], 0)
            better = size > length
            best, length = np.where(better, i, best), np.where(better, size, length)
        hit = length > 0
        out[open_[hit]] = x.name[best[hit]]
        open_ = open_[~hit]
    return out


def window_keys(h: np.ndarray, p: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash for the windows that begin at ``p``."""
    one, two = (runs_hashed(h, p, p + width, odd) for odd in (ODD, ODD2))
    return one, (two >> np.uint64(32)).astype(np.uint32)


def opened(body: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """doc_ids, known, texts."""
    doc_ids, known, sizes, data = blocks.get(body)
    ends = np.cumsum(sizes.astype(np.int64))
    return doc_ids, known, [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def extremes(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the least and the greatest of their ids."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], i[first], i[np.append(first[1:], len(k)) - 1] if len(k) else i[:0]


def split(shards: int, width: int, rounds: int):
    """Rows of blocks; the requests hold the distinct symbols that windows chose, with least and greatest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in blocks.batched(batches, BLOCK_CHARS):
            texts = [t.encode() for t in texts]
            doc_ids, known = blocks.ids_of(ids)
            body = blocks.put(doc_ids, known, np.array([len(t) for t in texts], np.uint32), b"".join(texts))
            block = blocks.name(body)
            h, lengths = word_hashes(texts)
            chosen = anchors(h, lengths, width, rounds)
            _, of = windows_of(lengths, width)
            keep = np.append(True, (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])) if len(chosen) else np.zeros(0, bool)
            keep &= known[of] > 0
            keys, low, high = extremes(chosen[keep], doc_ids[of[keep]])
            rows = blocks.deal(block, keys, shards, lambda mine, k=keys, a=low, z=high: blocks.put(k[mine], a[mine], z[mine]))
            yield blocks.rows_of([(block, -1, body), *rows])

    return run


def shared_symbols(requests: list[bytes]) -> list[bytes]:
    """Answer of a shard: of each block's symbols, those that two doc_ids hold."""
    asked = [blocks.get(d) for d in requests]
    keys, low, high = (np.concatenate(c) for c in zip(*asked, strict=True))
    distinct, at = np.unique(keys, return_inverse=True)
    least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, high)
    many = least < most
    return [blocks.put(a[0][many[np.searchsorted(distinct, a[0])]]) for a in asked]


def candidate_windows(shards: int, width: int, rounds: int):
    """Finish of the first return: requests with the distinct windows whose symbol is shared, and their least doc_id."""

    def finish(body: bytes, answers: list[bytes]) -> pa.Table:
        doc_ids, known, texts = opened(body)
        h, lengths = word_hashes(texts)
        shared = np.sort(np.concatenate([*[blocks.get(d)[0] for d in answers], np.zeros(0, np.uint64)]))
        p, of = windows_of(lengths, width)
        chosen = anchors(h, lengths, width, rounds)
        at = np.minimum(np.searchsorted(shared, chosen), max(len(shared) - 1, 0))
        keep = np.flatnonzero((shared[at] == chosen) & (known[of] > 0)) if len(shared) else np.zeros(0, np.int64)
        if not len(keep):
            return blocks.FIELDS.empty_table()
        one, two = window_keys(h, p[keep], width)
        ids = doc_ids[of[keep]]
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        first = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.zeros(0, bool)
        last = np.append(np.flatnonzero(first)[1:], len(one)) - 1
        several = (ids[last] > ids[first]).astype(np.uint8)
        one, two, ids = one[first], two[first], ids[first]
        rows = blocks.deal(blocks.name(body), one, shards, lambda mine: blocks.put(one[mine], two[mine], ids[mine], several[mine]))
        return pa.Table.from_batches([blocks.rows_of(rows)], blocks.FIELDS)

    return finish


def repeated_windows(requests: list[bytes]) -> list[bytes]:
    """Answer of a shard: each block's windows that a smaller doc_id holds, and whether the block holds the smallest itself."""
    asked = [blocks.get(d) for d in requests]
    one, two, ids, several = (np.concatenate(c) for c in zip(*asked, strict=True))
    order = np.lexsort((ids, two, one))
    first = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order][first][np.cumsum(first) - 1]
    own = ids == least
    useful = ~own | (several > 0)
    out, end = [], 0
    for a in asked:
        mine = slice(end, end + len(a[0]))
        end += len(a[0])
        k = useful[mine]
        out.append(blocks.put(a[0][k], a[1][k], own[mine][k].astype(np.uint8)))
    return out


def cleaned(width: int):
    def finish(body: bytes, answers: list[bytes]) -> pa.Table:
        doc_ids, known, texts = opened(body)
        h, lengths = word_hashes(texts)
        parts = [blocks.get(d) for d in answers]
        one, two, own = (np.concatenate([*[x[c] for x in parts], np.zeros(0, t)]) for c, t in enumerate((np.uint64, np.uint32, np.uint8)))
        order = np.lexsort((two, one))
        one, two, own = one[order], two[order], own[order]
        p, of = windows_of(lengths, width)
        covered = np.zeros(len(h) + 1, np.int64)
        if len(one):
            a, b = window_keys(h, p, width)
            at = np.searchsorted(one, a)
            hit = np.full(len(p), -1)
            for k in range(4):  # the first 64 bits of different windows are hardly ever equal
                i = np.minimum(at + k, len(one) - 1)
                hit = np.where((hit < 0) & (one[i] == a) & (two[i] == b), i, hit)
            found = np.flatnonzero((hit >= 0) & (known[of] > 0))
            ids = doc_ids[of[found]]
            least = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(least, hit[found], ids)
            gone = found[(own[hit[found]] == 0) | (ids > least[hit[found]])]
            np.add.at(covered, p[gone], 1)
            np.add.at(covered, p[gone] + width, -1)
        dead = np.cumsum(covered)[:-1] > 0
        rows, end = {f: [] for f in FIELDS.names}, 0
        for i, ok, text in zip(doc_ids.tolist(), known.tolist(), texts, strict=True):
            ws = text.split()
            mine = dead[end : end + len(ws)]
            end += len(ws)
            n = int(mine.sum())
            kept = ws if not n else [w for w, x in zip(ws, mine.tolist(), strict=True) if not x]
            for f, v in zip(FIELDS.names, (i if ok else None, len(ws), n, b" ".join(kept).decode()), strict=True):
                rows[f].append(v)
        return pa.table(rows, schema=FIELDS)

    return finish


def without_repeats(docs: DataFrame, width: int = 50, rounds: int = 6) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept (the words left, joined by a space).

    A word goes if a window of ``width`` consecutive words of its document covers it whose words also start in a
    document with a smaller doc_id; all windows are judged on the input. Whatever the smaller document loses
    itself, the first occurrence of a passage stays with the smallest doc_id.

    Null text or no words: nothing to remove, kept is empty. Texts under ``width`` words stay whole. Rows with a null
    doc_id neither lose words nor make others lose them. Rows with equal doc_ids do not count as repeats of each
    other. Empty table: no rows. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = blocks.shards_for(docs)
    rows = cut(base.mapInArrow(split(shards, width, rounds), blocks.ROWS))
    bodies = rows.where("shard < 0")
    symbols = blocks.answered(rows.where("shard >= 0"), shared_symbols, shards)
    windows = blocks.rejoined(bodies, symbols, candidate_windows(shards, width, rounds), blocks.ROWS, blocks.FIELDS)
    repeats = blocks.answered(windows, repeated_windows, shards)
    return blocks.rejoined(bodies, repeats, cleaned(width), SCHEMA, FIELDS)


def digest(cleaned_docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return cleaned_docs.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
