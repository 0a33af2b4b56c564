"""Bigram language model: quantised counts in a log-frequency Bloom filter, probed by the workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm import blocks
from tallyseq.llm.common import cut, fold, mix64, word_hashes

END = np.uint64(0x9E3779B97F4A7C15)  # stands for the end of a text, and for what precedes its first word
FIRST_PROBES, FIRST_BITS = 16, 24  # an unseen pair is found at level 1 once in about 100,000 times
PROBES, BITS = 8, 12  # for each further level of a pair that is there
CHUNK = 100_000
SHARD = 14_000_000
COUNTED = "block long, shard int, data binary, tokens long, types long"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
FIELDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def level(counts: np.ndarray, base: float) -> np.ndarray:
    """Quantised count: 1 + floor(log_base(count)), 0 for a count of 0."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9), 0).astype(np.uint8)


def value(levels: np.ndarray, base: float) -> np.ndarray:
    """Count that a level stands for: the least of its range, 0 for level 0."""
    return np.where(levels > 0, np.ceil(base ** (levels - 1.0) - 1e-9), 0).astype(np.int64)


def positions(keys: np.ndarray, q: int, bits: int) -> np.ndarray:
    """Bit positions for each key at level ``q``, by double hashing."""
    h = mix64(keys + np.uint64(q * int(END) % (1 << 64)))
    step = mix64(h) | np.uint64(1)
    return ((h[:, None] + np.arange(FIRST_PROBES if q == 1 else PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def built(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Filter of a shard as packed bits: a key of level q is entered with 1 ... q."""
    first = int((levels > 0).sum())
    entries = FIRST_BITS * first + BITS * (int(levels.sum(dtype=np.int64)) - first)
    bits = np.zeros(max(64, -(-entries // 8) * 8), bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        mine = keys[levels >= q]
        for at in range(0, len(mine), CHUNK):
            bits[positions(mine[at : at + CHUNK], q, len(bits)).ravel()] = True
    return np.packbits(bits)


def probed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Level of each key: the number of levels found in turn before the first that is absent."""
    out = np.zeros(len(keys), np.uint8)
    for start in range(0, len(keys), CHUNK):
        alive, q = np.arange(start, min(start + CHUNK, len(keys))), 1
        while len(alive):
            at = positions(keys[alive], q, 8 * len(bits))
            alive = alive[((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)]
            out[alive] = q
            q += 1
    return out


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, each text's end included, and the number of tokens of each text."""
    h, words = word_hashes([t.encode().lower() for t in texts])
    out = np.full(len(h) + len(texts), END)
    lengths = words + 1
    out[blocks.ragged(np.cumsum(lengths) - lengths, words)] = h
    return out, lengths


def contexts(tokens: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first is END, which ended the text before it."""
    return np.append(END, tokens[:-1])


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """Key of (the token before, the token)."""
    return mix64(mix64(contexts(tokens)) + tokens)


def dealt(pairs: np.ndarray, shards: int) -> list[np.ndarray]:
    """Indexes of the pairs of each shard, in order."""
    of = (pairs % np.uint64(shards)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return np.split(order, np.searchsorted(of[order], np.arange(1, shards)))


def short(pairs: np.ndarray) -> np.ndarray:
    """The 40 bits by which a shard knows its pairs."""
    return pairs >> np.uint64(24)


def gaps(rising: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first as it is; cumsum() undoes it."""
    return np.diff(rising, prepend=np.uint64(0))


def halves(x: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``low`` lowest bits and the rest: apart, the rest compresses by itself."""
    return (x & np.uint64((1 << low) - 1)).astype(np.uint8 if low <= 8 else np.uint32), (x >> np.uint64(low)).astype(np.uint32)


def whole(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(bits)) | low


def split(shards: int, part: str):
    """Rows of blocks: ``part`` bodies gives the documents, words or pairs the requests with the training counts of a block's distinct keys.

    The three are made by separate reads of the same table, as storing them would take more than twice its size. A block
    is named by its texts, so all agree; its size bounds the memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, more in blocks.batched(batches):
            doc_ids, known = blocks.ids_of(ids)
            held = np.array(more["held_out"], np.uint8)
            tokens, lengths = tokens_of(texts)
            block = blocks.name(doc_ids.tobytes() + lengths.tobytes() + tokens.tobytes())
            train = np.repeat(held == 0, lengths)
            if part == "pairs":
                keys, first, at = np.unique(bigrams(tokens), return_index=True, return_inverse=True)
                before, counts = contexts(tokens)[first], np.bincount(at[train], minlength=len(keys)).astype(np.uint32)
                rows = []
                for s, mine in enumerate(dealt(keys, shards)):
                    if len(mine):
                        ctx, of = np.unique(before[mine], return_inverse=True)
                        rows.append((block, s, blocks.put(*halves(gaps(short(keys[mine])), 24), counts[mine], gaps(ctx), *halves(of.astype(np.uint64), 8))))
                yield blocks.rows_of(rows)
                continue
            keys, stream = np.unique(tokens, return_inverse=True)
            order = np.argsort(-np.bincount(stream, minlength=len(keys)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(keys), np.uint32)
            rank[order] = np.arange(len(keys), dtype=np.uint32)
            keys, stream = keys[order], rank[stream]
            if part == "words":
                counts = np.bincount(stream[train], minlength=len(keys)).astype(np.uint32)
                yield blocks.rows_of(blocks.deal(block, keys, shards, lambda mine, k=keys, c=counts: blocks.put(np.diff(mine, prepend=0).astype(np.uint32), k[mine], c[mine])))
            else:
                yield blocks.rows_of([(block, -1, blocks.put(doc_ids, known, held, lengths.astype(np.uint32), stream, keys))])

    return run


def pair_tables(shards: int, base: float, answer: bool):
    """A shard of pairs: the filter of those seen in training, and what it gives back.

    Rows of blocks: shards + s with the levels of each block's pairs (if ``answer``), else -1 - s with the filter's bits; and 0 ... shards - 1 with
    the sums of what the stored pairs of a context stand for, for the shard of that word.
    """

    def run(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        asked = [blocks.get(x.as_py()) for x in table.column("data")]
        ends = np.cumsum([len(a[0]) for a in asked])
        flat = np.concatenate([np.cumsum(whole(a[0], a[1], 24)) for a in asked])
        keys, first, at = np.unique(flat, return_index=True, return_inverse=True)
        counts = np.bincount(at, np.concatenate([a[2] for a in asked]), len(keys)).astype(np.int64)
        before = np.concatenate([np.cumsum(a[3])[whole(a[4], a[5], 8)] for a in asked])[first]
        bits = built(keys, level(counts, base))
        levels = probed(bits, keys)
        rows = [(b, shards + s, blocks.put(np.array([s]), x)) for b, x in zip(table.column("block").to_pylist(), np.split(levels[at], ends[:-1]), strict=True)] if answer else [(0, -1 - s, bits.tobytes())]
        seen = counts > 0
        ctx, of = np.unique(before[seen], return_inverse=True)
        sums = np.bincount(of, value(levels[seen], base), len(ctx)).astype(np.int64)
        rows += blocks.deal(s, ctx, shards, lambda mine: blocks.put(ctx[mine], sums[mine]))
        return pa.Table.from_batches([blocks.rows_of(rows)])

    return run


def word_counts(asked_words: pa.Table, partial: pa.Table) -> pa.Table:
    """Training counts of each block's words, and what the stored pairs after them stand for; the shard's tokens and types stand in its first row."""
    asked = [blocks.get(x.as_py()) for x in asked_words.column("data")]
    if not asked:
        return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "tokens": pa.array([], pa.int64()), "types": pa.array([], pa.int64())})
    keys, at = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([a[2] for a in asked]), len(keys)).astype(np.uint32)
    sums = np.zeros(len(keys), np.int64)
    for data in partial.column("data"):
        ctx, n = blocks.get(data.as_py())
        sums[np.searchsorted(keys, ctx)] += n
    ends = np.cumsum([len(a[1]) for a in asked])
    data = [blocks.put(a[0], counts[at[e - len(a[1]) : e]], sums[at[e - len(a[1]) : e]]) for a, e in zip(asked, ends, strict=True)]
    rest = [0] * (len(asked) - 1)
    return pa.table({"block": asked_words.column("block"), "shard": asked_words.column("shard"), "data": pa.array(data, pa.binary()), "tokens": pa.array([int(counts.sum(dtype=np.int64)), *rest], pa.int64()), "types": pa.array([int((counts > 0).sum()), *rest], pa.int64())})


def scored(shared, shards: int, tokens: int, types: int, base: float, mu: float):
    """``shared``: the broadcast filter, or None where the answers hold the levels."""

    def finish(body: bytes, answers: list[bytes]) -> pa.Table:
        doc_ids, known, held, lengths, stream, keys = blocks.get(body)
        lengths = lengths.astype(np.int64)
        pairs, at = np.unique(bigrams(keys[stream]), return_inverse=True)
        counts, sums = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        levels, mine = np.full(len(pairs), 255, np.uint8), dealt(pairs, shards)
        for data in answers:
            which, *found = blocks.get(data)
            if which.dtype == np.int64:
                levels[mine[which[0]]] = found[0]
            else:
                i = np.cumsum(which.astype(np.int64))
                counts[i], sums[i] = found
        if shared is not None:
            for s, bits in enumerate(shared.value):
                levels[mine[s]] = probed(np.frombuffer(bits, np.uint8), short(pairs[mine[s]]))
        if (counts < 0).any() or (levels == 255).any():
            raise RuntimeError("a block lacks the counts of some of its words or pairs")
        starts = np.cumsum(lengths) - lengths
        before = np.append(0, stream[:-1]).astype(np.int64)
        before[starts] = np.flatnonzero(keys == END)[0]
        uniform = (counts + 1.0) / (tokens + types + 1.0)
        c1, c2 = counts[before], counts[stream]
        stored = np.where((c1 > 0) & (c2 > 0), value(levels, base)[at], 0)  # no pair has a part that is not there
        p = (c1 * (stored / np.maximum(sums[before], 1)) + mu * uniform[stream]) / (c1 + mu)
        total = [np.add.reduceat(x, starts) for x in ((c2 > 0).astype(np.int64), np.log10(uniform[stream]), np.log10(p))]
        columns = [pa.array(doc_ids, mask=known == 0), pa.array(held > 0), pa.array(lengths), pa.array(total[0]), pa.array(np.full(len(doc_ids), tokens)), pa.array(total[1]), pa.array(total[2])]
        return pa.table(columns, schema=FIELDS)

    return finish


def score(docs: DataFrame, folds: int = 7, held: int = 2, base: float = 1.5, mu: float = 2000.0, most_mb: int = 256) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all documents whose crc32(doc_id) modulo ``folds`` is not ``held``. Tokens: the words with A-Z lower-cased, then one end. Word
    counts c are exact; base_score sums log10 of p = (c + 1) / (N + V + 1) over the tokens. All pairs seen in training
    enter a log-frequency Bloom filter with their level 1 + floor(log_base(count)); a worker finds a pair's level by
    probing 1, 2, ... until one is absent, and takes the least count of that level. score sums log10 of
    (c1 * stored(v, w) / sum of stored(v, .) + mu * p(w)) / (c1 + mu), where c1 counts the token v before (for the first, the ends). The
    sum is over the pairs that the filter holds, so a context's probabilities over the known words and one unknown add up to 1, but for unseen pairs that the
    filter takes for seen, one in about 100,000.

    A filter has FIRST_BITS bits for each pair and BITS for each further level, one part for each shard of pairs; that is 1.5 bytes for each byte of text and 3 for each document
    at most. Where this bound is within ``most_mb`` the parts are broadcast; else each stays with its shard, which probes it for all
    blocks that hold its pairs. Both give the same levels.

    Null or empty text: the end alone. A null doc_id counts as not held out. Repeated rows count each. No training
    document: N and V are 0, c is 0. Empty table: no rows. Other columns are ignored. ``docs`` is read several times and must give the same
    rows in the same partitions each time, as tables do.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text"), F.count("*").alias("rows")).first()
    shards = max(4, -(-size["text"] // SHARD))
    small = 1.5 * size["text"] + 3 * size["rows"] <= most_mb << 20
    made = {part: rows.mapInArrow(split(shards, part), blocks.ROWS) for part in ("bodies", "words", "pairs")}
    pairs = cut(blocks.answered_rows(made["pairs"], pair_tables(shards, base, not small), shards))
    partial = pairs.where(F.col("shard").between(0, shards - 1))
    answers = cut(made["words"].repartition(shards, "shard").groupBy("shard").cogroup(partial.repartition(shards, "shard").groupBy("shard")).applyInArrow(word_counts, COUNTED))
    tokens, types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    answers, shared = answers.select("block", "shard", "data"), None
    if small:
        filters = [bytes(8)] * shards
        for r in pairs.where("shard < 0").collect():
            filters[-1 - r["shard"]] = bytes(r["data"])
        shared = spark.sparkContext.broadcast(filters)
    else:
        answers = answers.unionByName(pairs.where(F.col("shard") >= shards))
    return blocks.rejoined(made["bodies"], answers, scored(shared, shards, tokens, types, base, mu), SCHEMA, FIELDS)
