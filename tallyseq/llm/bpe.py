"""BPE by a distinct-word table: each distinct word is encoded once, ids go back by position.

Blocks (see blocks.py) hold documents as indexes into the block's distinct words. The words, dealt by hash, meet
in the word table, where each distinct word of the corpus is encoded once; the ids return to the blocks, which put them
in the place of the indexes. Decoding looks each id up in the table of pieces, whose size the vocabulary fixes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm import blocks

SEP = b"\xff"  # in no UTF-8 text
LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def words_of(text: str) -> list[str]:
    """Cuts that no token crosses: before a lone space between other characters, and on both sides of a lone newline.

    Joined, the words are the text again. No byte-level token has a space after another character, and
    of a run of white space only the last character may begin a token; so a single one is safe to cut at.
    """
    parts = text.split("\n")
    segments, segment = [], parts[0]
    for part in parts[1:]:
        if segment and part and not segment[-1].isspace() and not part[0].isspace():
            segments.append(segment)
            segment = part
        else:
            segment += f"\n{part}"
    segments.append(segment)
    out = []
    for i, segment in enumerate(segments):
        if i:
            out.append("\n")
        words = segment.split(" ")
        if words == segment.split():
            out.append(words[0])
            out += [f" {w}" for w in words[1:]]
        else:
            out += [w for w in LONE_SPACE.split(segment) if w]
    return out


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def pieces(path: str) -> list[bytes]:
    """Bytes of each id. The byte-level alphabet: printable Latin-1 characters are themselves, the others follow from 256 on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    names = {i: bytes(byte[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    names |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [names.get(i, b"") for i in range(max(names) + 1)]


def split(shards: int, part: str):
    """Rows of blocks: ``part`` bodies gives the documents, words the requests.

    Both are made by separate reads of the same table, as storing them would take its size again. A block is
    named by its documents and words, so both agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in blocks.batched(batches):
            index: dict[str, int] = {}
            lengths, streams = [], []
            for t in texts:
                s = [index.setdefault(w, len(index)) for w in words_of(t)]
                lengths.append(len(s))
                streams.append(np.array(s, np.uint32))
            stream = np.concatenate(streams)
            words = [w.encode() for w in index]
            order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            words = [words[i] for i in order]
            doc_ids, known = blocks.ids_of(ids)
            lengths, stream = np.array(lengths, np.uint32), rank[stream]
            block = blocks.name(doc_ids.tobytes() + lengths.tobytes() + stream.tobytes() + SEP.join(words))
            if part == "bodies":
                yield blocks.rows_of([(block, -1, blocks.put(doc_ids, known, np.array([len(words)], np.int64), lengths, stream))])
                continue
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            yield blocks.rows_of(blocks.deal(block, keys, shards, lambda mine, words=words: blocks.put(np.diff(mine, prepend=0).astype(np.uint32), SEP.join([words[i] for i in mine]))))

    return run


def word_table(path: str):
    """Answer of a shard: the ids of each block's words, from one table of the shard's distinct words."""

    def answer(requests: list[bytes]) -> list[bytes]:
        table: dict[bytes, int] = {}
        asked = []
        for data in requests:
            mine, words = blocks.get(data)
            asked.append((mine, np.array([table.setdefault(w, len(table)) for w in words.split(SEP)], np.int64)))
        lengths, flat = [], []
        words, tok = list(table), tokenizer(path)
        for at in range(0, len(words), 20_000):
            found = [tok.encode(w.decode(), add_special_tokens=False).ids for w in words[at : at + 20_000]]
            lengths += map(len, found)
            flat.append(np.array([i for ids in found for i in ids], np.uint32))
        n, flat = np.array(lengths, np.int64), np.concatenate(flat)
        starts = np.cumsum(n) - n
        return [blocks.put(mine, n[w].astype(np.uint32), flat[blocks.ragged(starts[w], n[w])]) for mine, w in asked]

    return answer


def assembled(path: str):
    def finish(body: bytes, answers: list[bytes]) -> pa.Table:
        piece = pieces(path)
        doc_ids, known, size, lengths, stream = blocks.get(body)
        count, starts = np.full(int(size[0]), -1, np.int64), np.zeros(int(size[0]), np.int64)
        flat, base = [], 0
        for data in answers:
            gaps, n, ids = blocks.get(data)
            mine = np.cumsum(gaps.astype(np.int64))
            count[mine], starts[mine] = n, base + np.cumsum(n.astype(np.int64)) - n
            flat.append(ids)
            base += len(ids)
        if (count < 0).any():
            raise RuntimeError("a block lacks the ids of some of its words")
        flat = np.concatenate([*flat, np.zeros(0, np.uint32)])
        rows, at = {f: [] for f in FIELDS.names}, 0
        for doc_id, ok, n in zip(doc_ids.tolist(), known.tolist(), lengths.tolist(), strict=True):
            words = stream[at : at + n]
            at += n
            ids = flat[blocks.ragged(starts[words], count[words])]
            rows["doc_id"].append(doc_id if ok else None)
            rows["n_tokens"].append(len(ids))
            rows["ids"].append(ids.astype("<u4").tobytes())
            text = b"".join(itemgetter(*ids.tolist())(piece)) if len(ids) > 1 else b"".join(piece[i] for i in ids)
            rows["decoded"].append(text.decode("utf-8", "replace"))
        return pa.table(rows, schema=FIELDS)

    return finish


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    ``path``: a byte-level BPE file of the tokenizers library, present on every executor. ids: what the library's encode() gives
    for the whole text without adding special tokens. decoded: the pieces of the ids joined, which is the
    text. Null or empty text: no ids and an empty text. A null doc_id stays null. Repeated rows each get the same
    answer. Empty table: no rows. Other columns are ignored. ``docs`` is read twice and must give the same rows in the same partitions
    both times, as tables do; where it does not, a block lacks its ids and an error is raised.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = blocks.shards_for(docs)
    bodies, words = (base.mapInArrow(split(shards, part), blocks.ROWS) for part in ("bodies", "words"))
    return blocks.rejoined(bodies, blocks.answered(words, word_table(path), shards), assembled(path), SCHEMA, FIELDS)


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
