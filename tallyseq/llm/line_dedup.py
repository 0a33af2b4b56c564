"""Fuzzy line dedup: character shingles, MinHash bands, exact Jaccard check, union-find; one line per component stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm import blocks
from tallyseq.llm.common import ODD, cut, mix64
from tallyseq.llm.neardup import links

WIDTH = 8
CHUNK = 50_000
BLOCK_BYTES = 3_000_000
SPACES = b" \t\n\v\f\r"
LATIN = bytes(range(0xC4))  # bytes of UTF-8 that characters below 256 are made of


def latin(line: bytes) -> bool:
    """Whether all characters are below 256."""
    return line.isascii() or not line.translate(None, LATIN)


def chunks(lines: list[bytes]) -> Iterator[list[int]]:
    """Indexes of the lines in runs of about CHUNK bytes, whose hashes stay in the cache; lines of characters below 256 alone come first."""
    plain = [latin(x) for x in lines]
    for kind in (True, False):
        run, size = [], 0
        for i, x in enumerate(lines):
            if plain[i] == kind:
                run.append(i)
                size += len(x)
                if size >= CHUNK:
                    yield run
                    run, size = [], 0
        if run:
            yield run


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of WIDTH characters, line by line, and how many each line has; a shorter line is one run.

    WIDTH characters below 256 are one 64-bit word, which is what their hash is made of; other runs are hashed from their code points.
    """
    if all(map(latin, lines)):
        singles = [x if x.isascii() else x.decode().encode("latin-1") for x in lines]
        lengths = np.fromiter(map(len, singles), np.int64, len(lines))
        data = b"".join([x.ljust(WIDTH, b"\0") for x in singles])
        h = np.ndarray((len(data) - WIDTH + 1,), "<u8", data, strides=(1,)).astype(np.uint64)
    else:
        texts = [x.decode() for x in lines]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join([t.ljust(WIDTH, "\0") for t in texts]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        other, word, h, size = codes > np.uint64(255), codes, mix64(codes + np.uint64(1)), 1
        while size < WIDTH:
            other = other[:-size] | other[size:]
            word = word[:-size] | (word[size:] << np.uint64(8 * size))
            h = h[:-size] * np.uint64(pow(int(ODD), size, 1 << 64)) + h[size:]
            size *= 2
        h = np.where(other, h, word)
    wide = np.maximum(lengths, WIDTH)
    ends = np.cumsum(wide)[:-1] - (WIDTH - 1)
    across = (ends[:, None] + np.arange(WIDTH - 1)).ravel()  # runs that begin in one line and end in the next
    return mix64(np.delete(h, across)), wide - WIDTH + 1


def signatures(lines: list[bytes], k: int) -> np.ndarray:
    """A row for each line: 32-bit minima of half of ``k`` permutations, then the maxima of the same ones.

    Two lines agree in either with the probability of their similarity. In both they agree less often than if these were independent, so bands
    of minima and bands of maxima miss a pair together no more often than bands of as many permutations.
    """
    half = -(-k // 2)
    rng = np.random.default_rng(19970611)
    a, c = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)
    out = np.empty((len(lines), k), np.uint32)
    for which in chunks(lines):
        h, many = shingle_hashes([lines[i] for i in which])
        x, starts = (h >> np.uint64(32)).astype(np.uint32), np.cumsum(many) - many
        t, ends = np.empty_like(x), np.empty((2 * half, len(which)), np.uint32)
        for j in range(half):
            np.multiply(x, a[j], out=t)
            t += c[j]
            np.minimum.reduceat(t, starts, out=ends[j])
            np.maximum.reduceat(t, starts, out=ends[half + j])
        out[which] = ends[:k].T
    return out


def ids_of(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK_BYTES, one row at least; columns other than text count by their mean."""
    for b in batches:
        text = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = max(0, b.nbytes - int(text.sum())) // max(1, b.num_rows)
        sizes = np.cumsum(text + rest)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def packed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as out:
        out.write_batch(b)
    return blocks.squeeze(sink.getvalue().to_pybytes())


def opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(blocks.widen(body)).read_all()


def lines_of(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(row, line number, line) of the lines that take part: not blank, of a row with a doc_id. Lines are as they are compared: A-Z lower-cased, no ASCII white space at the ends."""
    for r, (i, t) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), strict=True)):
        if i is not None and t:
            for n, line in enumerate(t.lower().split(b"\n")):
                if line := line.strip(SPACES):
                    yield r, n, line


def bodies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks: the documents."""
    for b in sliced(batches):
        body = packed(b)
        yield blocks.rows_of([(blocks.name(body), -1, body)])


class Lines:
    """Distinct lines of a block, in order of appearance, and the first place of each by (doc_id, line number).

    ``at`` is that place's number among all lines of the block that take part.
    """

    def __init__(self, rows: pa.Table) -> None:
        doc_ids, first = rows.column("doc_id").to_pylist(), {}
        for at, (r, n, line) in enumerate(lines_of(rows)):
            place = (doc_ids[r], n, at)
            known = first.setdefault(line, place)
            if place < known:
                first[line] = place
        self.lines = list(first)
        places = np.array(list(first.values()), np.int64).reshape(len(first), 3)
        self.doc_id, self.n, self.at = places[:, 0].copy(), places[:, 1].astype(np.uint32), places[:, 2].astype(np.int32)


def claims(shards: int):
    """Rows of blocks: requests that hold the 64-bit hashes of the block's distinct lines and their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                own = Lines(opened(body.as_py()))
                ids = ids_of(own.lines)
                pack = lambda mine, ids=ids, own=own: blocks.put(np.diff(mine, prepend=0).astype(np.uint32), ids[mine], own.doc_id[mine], own.n[mine])
                yield blocks.rows_of(blocks.deal(block, ids, shards, pack))

    return run


def owners(table: pa.Table) -> pa.Table:
    """Answer of a shard to claims: the lines of each block whose first place over all blocks is there; of equal places the block of the smallest name."""
    asked = [blocks.get(x.as_py()) for x in table.column("data")]
    sizes = [len(a[1]) for a in asked]
    block = np.repeat(table.column("block").to_numpy(), sizes)
    ids, doc_id, n = (np.concatenate([a[c] for a in asked]) for c in (1, 2, 3))
    order = np.lexsort((block, n, doc_id, ids))
    ids, doc_id, n, block = ids[order], doc_id[order], n[order], block[order]
    new = np.append(True, ids[1:] != ids[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = np.empty(len(ids), bool)
    own[order] = (doc_id == doc_id[first]) & (n == n[first]) & (block == block[first])
    data = [blocks.put(np.cumsum(a[0].astype(np.int64))[mine].astype(np.uint32)) for a, mine in zip(asked, np.split(own, np.cumsum(sizes)[:-1]), strict=True)]
    return pa.table([table.column("block"), table.column("shard"), pa.array(data, pa.binary())], schema=blocks.FIELDS)


def numbers(answers: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([*[blocks.get(d)[0] for d in answers], np.zeros(0, np.uint32)]))


def split(shards: int, bands: int, rows: int):
    """Requests of a block: band keys of the lines it owns. Each line has one owner, so equal keys are of different lines.

    A shard gets the upper 32 bits of the keys that fall to it by their remainder, and of each the line's number times ``bands`` plus the band's.
    """

    def finish(body: bytes, answers: list[bytes]) -> pa.Table:
        lines, which = Lines(opened(body)).lines, numbers(answers)
        if lines and not answers:
            raise RuntimeError("a block lacks the owners of its lines")
        lines = [lines[i] for i in which.tolist()]
        sig = signatures(lines, bands * rows).reshape(len(lines), bands, rows)
        key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(lines), bands)).copy()
        for r in range(rows):
            key = mix64(key ^ sig[:, :, r])
        key, of = key.ravel(), (which[:, None] * np.uint32(bands) + np.arange(bands, dtype=np.uint32)).ravel()

        def pack(mine: np.ndarray) -> bytes:
            return blocks.put((key[mine] >> np.uint64(32)).astype(np.uint32), np.diff(of[mine], prepend=np.uint32(0)))

        block = blocks.name(body)
        return pa.Table.from_batches([blocks.rows_of(blocks.deal(block, key, shards, pack) or [(block, 0, pack(np.zeros(0, np.int64)))])])

    return finish


def shared_bands(requests: list[bytes]) -> list[bytes]:
    """Answer of a shard: each block's lines and bands whose key another line has too."""
    asked = [blocks.get(d) for d in requests]
    keys = np.concatenate([a[0] for a in asked])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    many = np.empty(len(keys), bool)
    many[order] = np.append(same, False) | np.append(False, same) if len(keys) else many
    parts = np.split(many, np.cumsum([len(a[0]) for a in asked])[:-1])
    return [blocks.put(np.unique(np.cumsum(a[1].astype(np.int64))[mine]).astype(np.uint32)) for a, mine in zip(asked, parts, strict=True)]


CANDIDATES = pa.schema([("id", pa.int64()), ("line", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("held", pa.binary())])


def candidates(bands: int):
    """Lines of a block that have company, and in which bands (held)."""

    def finish(body: bytes, answers: list[bytes]) -> pa.Table:
        own = Lines(opened(body))
        if own.lines and not answers:
            raise RuntimeError("a block lacks the answers about its lines")
        found = numbers(answers)
        mine, first = np.unique(found // np.uint32(bands), return_index=True)
        held = [x.tobytes() for x in np.split((found % np.uint32(bands)).astype(np.uint16), first[1:])][: len(mine)]
        lines = [own.lines[i] for i in mine.tolist()]
        return pa.table([ids_of(lines).view(np.int64), pa.array(lines, pa.binary()), own.doc_id[mine], own.n[mine].astype(np.int64), np.full(len(mine), blocks.name(body)), own.at[mine], pa.array(held, pa.binary())], schema=CANDIDATES)

    return finish


def sets_of(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each line."""
    out = [np.zeros(0, np.uint64)] * len(lines)
    for which in chunks(lines):
        h, many = shingle_hashes([lines[i] for i in which])
        for i, x in zip(which, np.split(h, np.cumsum(many)[:-1]), strict=True):
            x.sort()
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out[i] = x[new]
    return out


def described(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lines = part.column("line").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, sets_of(lines)), pa.int64()), pa.array([s.tobytes() for s in signatures(lines, k)], pa.binary()), part.column("held")], ["id", "n", "sig", "held"])

    return run


def thinned(bodies: pa.Table, answers: pa.Table) -> pa.Table:
    """cogroup function: the rows of a block without the lines that it doesn't own or that lost against a near line."""
    lost = set(answers.column("lost").drop_null().to_pylist())
    which = numbers([x.as_py() for x in answers.column("data").drop_null()])
    out = []
    for body in bodies.column("data"):  # several only if blocks are equal: the first keeps its lines
        rows = opened(body.as_py())
        own = Lines(rows)
        if own.lines and not answers.num_rows:
            raise RuntimeError("a block lacks the owners of its lines")
        stay = set(own.at[which].tolist()) - lost
        texts, removed, counts = rows.column("text").to_pylist(), [0] * rows.num_rows, [0] * rows.num_rows
        gone: dict[int, set[int]] = {}
        for at, (r, n, _) in enumerate(lines_of(rows)):
            counts[r] += 1
            if at not in stay:
                gone.setdefault(r, set()).add(n)
        for r, those in gone.items():
            texts[r] = "\n".join(x for n, x in enumerate(texts[r].split("\n")) if n not in those)
            removed[r] = len(those)
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        out.append(rows.append_column("n_lines", pa.array(counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())))
        which = which[:0]
    return pa.concat_tables(out)  # every answer is of a block, so there is one


def without_repeated_lines(docs: DataFrame, percent: int = 80, bands: int = 26, rows: int = 4, miss: float | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` with near-repeated lines taken out of text, and n_lines, n_removed; all rows stay.

    Lines are cut at \\n. Two lines are linked when 100 * intersection >= percent * union of their distinct runs of WIDTH
    characters (A-Z lower-cased, ends stripped; a shorter line is one run). Of each component of linked lines, over all
    documents, only the line of the smallest (doc_id, line number) stays. ``bands`` of ``rows`` minima propose the
    pairs; a pair at the threshold is missed with probability (1 - (percent / 100) ** rows) ** bands, 1e-6 at 80 %. All
    proposed pairs go to the exact check, unless ``miss`` is given: then signatures are compared before, which misses a pair with that probability. Lines are told apart by 64 bits of hash throughout.

    The table is cut into blocks once and kept so (checkpoint()); a block owns the lines whose first place it holds,
    asks the shards of their band keys for company, and only lines that have some leave it.

    Blank lines take no part and stay. Null or empty text is unchanged. Rows with a null doc_id neither lose
    lines nor make others lose them. Of repeated rows one keeps its lines. Other columns are passed on, but for n_lines and n_removed, which
    are replaced. n_chars, where present, is not changed. Empty table: no rows.
    """
    docs = docs.drop("n_lines", "n_removed").withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = blocks.shards_for(docs, 16_000_000)  # a line has a key for each band
    bodies = cut(docs.mapInArrow(bodies_of, blocks.ROWS))
    own = cut(blocks.answered_rows(bodies.mapInArrow(claims(shards), blocks.ROWS), owners, shards))
    keys = blocks.rejoined(bodies, own, split(shards, bands, rows), blocks.ROWS, blocks.FIELDS)
    shared = blocks.answered(keys, shared_bands, shards)
    places = blocks.rejoined(bodies, shared, candidates(bands), "id long, line binary, doc_id long, n long, block long, at int, held binary", CANDIDATES)
    lines = cut(places.groupBy("id").agg(F.first(F.struct("line", "doc_id", "n", "block", "at", "held")).alias("x")).select("id", "x.*"))
    classes = cut(lines.mapInArrow(described(bands * rows), "id long, n long, sig binary, held binary"))
    near = links(classes, lambda _: lines.select("id", F.col("line").alias("shingles")), percent, bands, rows, sets_of, miss, blocked=miss is None)
    linked = lines.drop("line", "held").join(near, "id")
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "n", "id")).alias("first")).select("component", F.col("first.id").alias("first"))
    lost = linked.join(first, "component").where("id <> first").select("block", F.lit(None).cast("binary").alias("data"), F.col("at").alias("lost"))
    answers = own.select("block", "data", F.lit(None).cast("int").alias("lost")).unionByName(lost)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema
    return bodies.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(thinned, schema)
