"""Alignments: SAM text through Spark's reader, BAM and tag bit-streams as Python data sources.

A BAM file is read by ranges of its bytes. A range looks for the next block header and, in what the blocks hold, for a place where records
begin, which it tells by their lengths and fields. read_bam() first lets each range count its records; what one range says of its end must
be what the next says of its beginning (if not, the next is counted again from there), so the numbers of records do not rest on the
guess. With these counts each partition reads its records, and those of a tag stream that stand at the same places, without a shuffle.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tallyseq.sources import stores
from tallyseq.sources.fastq import numbered_lines
from tallyseq.sources.stores import Part

SCHEMA = "rec_no long, qname string, flag int, mapq int, seq string, tags map<string,string>, nh int"
BAM_FIELDS = pa.schema([("rec_no", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("mapq", pa.int32()), ("seq", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("nh", pa.int32())])
CBUB_SCHEMA = "rec_no long, has_tags boolean, cb_idx long, umi string"
CBUB_FIELDS = pa.schema([("rec_no", pa.int64()), ("has_tags", pa.bool_()), ("cb_idx", pa.int64()), ("umi", pa.string())])


def read_sam(spark: SparkSession, path: str, max_records: int = 0) -> DataFrame:
    """Alignments of SAM text; rec_no counts the records of a file from 0. Header and empty lines go before lines are numbered, so no line meets another in a join; casts are tried only."""
    rows = numbered_lines(spark, [path], ~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t")
    tag = F.transform(F.filter(F.slice(f, 12, 1 << 16), lambda x: F.size(F.split(x, ":", 3)) == 3), lambda x: F.struct(F.split(x, ":", 3)[0].alias("key"), F.split(x, ":", 3)[2].alias("value")))
    tags = F.map_from_entries(F.array_distinct(tag))
    out = rows.select(F.col("line").alias("rec_no"), f[0].alias("qname"), F.get(f, F.lit(1)).try_cast("int").alias("flag"), F.get(f, F.lit(4)).try_cast("int").alias("mapq"), F.get(f, F.lit(9)).alias("seq"), tags.alias("tags"))
    out = out.withColumn("nh", F.try_element_at("tags", F.lit("NH")).try_cast("int"))
    return out.where(F.col("rec_no") < max_records) if max_records else out


Place = tuple[int, int]  # of a byte: where its block begins in the file, and how far into the block's content it is
FIRST = 12  # bytes of a block's head up to its extra fields


def block_size(head: bytes) -> int:
    """Bytes of the block that begins so, 0 if none does."""
    if len(head) < FIRST or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = head[FIRST : FIRST + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    return 0


def blocked(path: str) -> bool:
    """Whether a file consists of blocks that tell their size; other gzip files are read from the start only."""
    with stores.opened(path) as f:
        return block_size(f.read(1 << 16)) > 0


def next_block(f: pa.NativeFile, at: int, end: int) -> int:
    """Where the first block from ``at`` on begins, or ``end``: a head that another one, or the file's end, follows."""
    size = f.size()
    while at < end:
        f.seek(at)
        data = f.read(min(1 << 18, size - at))
        k = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= k < min(end - at, len(data) - 3):
            f.seek(at + k)
            n = block_size(f.read(1 << 16))
            f.seek(at + k + n)
            if n and (at + k + n == size or block_size(f.read(1 << 16))):
                return at + k
            k = data.find(b"\x1f\x8b\x08\x04", k + 1)
        at += max(1, len(data) - 3)
    return end


class Content:
    """What a file's blocks hold, from a block on, and where each byte of it stands."""

    def __init__(self, f: pa.NativeFile, block: int) -> None:
        self.source, self.buffer, self.base = self.inflated(f, block), bytearray(), 0
        self.starts: list[tuple[int, int]] = []  # (place in the content, block)
        self.size, self.at = f.size(), 0

    def inflated(self, f: pa.NativeFile, block: int) -> Iterator[tuple[int, bytes]]:
        """Gzip members, with the place of each in the file."""
        f.seek(block)
        z, rest, held = zlib.decompressobj(31), b"", []
        while data := rest or f.read(1 << 20):
            held.append(z.decompress(data))
            rest = z.unused_data
            if z.eof:
                yield block, b"".join(held)
                block, z, held = f.tell() - len(rest), zlib.decompressobj(31), []
        if any(held):
            raise ValueError("a block of the BAM file is cut off")

    def has(self, end: int) -> bool:
        """Makes the content up to ``end`` available; False if there is less."""
        while self.base + len(self.buffer) < end:
            more = next(self.source, None)
            if more is None:
                return False
            if more[1]:
                self.starts.append((self.base + len(self.buffer), more[0]))
                self.buffer.extend(more[1])
        return True

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.buffer[at - self.base : at - self.base + n])

    def take(self, n: int) -> bytes | None:
        """The next ``n`` bytes, None if there are fewer; what lies before them is let go."""
        if not self.has(self.at + n):
            return None
        out = self.get(self.at, n)
        self.at += n
        if self.at - self.base > 1 << 20:
            del self.buffer[: self.at - self.base]
            self.base = self.at
            while len(self.starts) > 1 and self.starts[1][0] <= self.at:
                self.starts.pop(0)
        return out

    def place(self) -> Place:
        """Where the next byte stands; the file's end if there is none."""
        if not self.has(self.at + 1):
            return self.size, 0
        start, block = next(x for x in reversed(self.starts) if x[0] <= self.at)
        return block, self.at - start

    def record(self) -> bytes | None:
        """The next alignment record, None at the end."""
        if (head := self.take(4)) is None:
            return None
        body = self.take(struct.unpack("<i", head)[0])
        if body is None:
            raise ValueError("a record of the BAM file is cut off")
        return body


def header(content: Content) -> int:
    """Passes the header; the number of reference sequences."""
    number = lambda: struct.unpack("<i", content.take(4) or b"\0" * 4)[0]
    if content.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    content.take(number())
    references = number()
    for _ in range(references):
        content.take(number() + 4)
    return references


def looks_right(head: bytes, references: int) -> int:
    """Length of the record that begins with these 36 bytes, 0 if its fields cannot be those of one."""
    length, ref, at, name, _, _, cigar, _, bases, mate, mate_at, _ = struct.unpack_from("<iiiBBHHHiiii", head)
    fits = -1 <= ref < references and -1 <= mate < references and at >= -1 and mate_at >= -1 and name and bases >= 0
    return 4 + length if fits and length >= 32 + name + 4 * cigar + (bases + 1) // 2 + bases else 0


def first_record(content: Content, references: int, chain: int = 10) -> bool:
    """Moves to the first place where ``chain`` records, or all up to the end, seem to follow each other; False if there is none in the block."""
    content.has(1)
    limit = content.at + len(content.buffer)
    for start in range(content.at, limit):
        at, good = start, 0
        while good < chain and content.has(at + 37):
            length = looks_right(content.get(at, 36), references)
            if not length:
                break
            name = content.get(at + 36, content.get(at + 12, 1)[0]) if content.has(at + 36 + content.get(at + 12, 1)[0]) else b""
            if name[-1:] != b"\0" or b"\0" in name[:-1]:
                break
            at, good = at + length, good + 1
        else:
            if good and (good == chain or not content.has(at + 1)):
                content.at = start
                return True
    return False


def counted(path: str, first: int, end: int, start: Place | None) -> tuple[Place, Place, int]:
    """(place of the first record, place after the last, records) of the records that begin in blocks of the bytes first to end.

    ``start``: the first record's place, if it is known; else it is looked for. Without records both places are those of the end.
    """
    none = ((end, 0), (end, 0), 0)
    with stores.opened(path) as f:
        references = header(content := Content(f, 0))
        if first == 0:
            start = start or content.place()
        if start is None:
            block = next_block(f, first, end)
            while block < end:
                content = Content(f, block)
                if first_record(content, references):
                    start = content.place()
                    break
                block = next_block(f, block + 1, end)
            if start is None:
                return none
        if start[0] >= end:
            return start, start, 0
        content = Content(f, start[0])
        content.take(start[1])
        n = 0
        while (at := content.place())[0] < end:
            content.record()
            n += 1
        return start, at, n


def bam_index(spark: SparkSession, path: str, split: int = stores.SPLIT) -> list[tuple[Place, int, int]]:
    """(place of the first record, number of the first record, records) for each byte range of a BAM file that holds any."""
    size = stores.size_of(path)
    spans = stores.ranges(size, split if blocked(path) else size)
    ask = lambda rows: [((r[1], r[2]), (r[3], r[4]), r[5], r[0]) for r in stores.on_executors(spark, rows, "at long, end long, block long, skip long", _count(path), "first long, block long, skip long, to_block long, to_skip long, held long")]
    found = {r[3]: r for r in ask([(a, b, None, None) for a, b in spans])}
    expected, first, out = None, 0, []
    for a, b in spans:
        start, end, n, _ = found[a]
        if expected is not None and expected[0] >= b:
            if n:  # nothing begins here, whatever was found
                start, end, n = expected, expected, 0
        elif expected is not None and start != expected:
            ((start, end, n, _),) = ask([(a, b, *expected)])
        expected = end if n or expected is None else expected
        if n:
            out.append((start, first, n))
        first += n
    return out


def _count(path: str):  # noqa: ANN202
    def work(row: tuple) -> tuple:
        a, b, block, skip = row
        start, end, n = counted(path, a, b, None if block is None else (block, skip))
        return a, *start, *end, n

    return work


def read_bam(spark: SparkSession, path: str, max_records: int = 0, split: int = stores.SPLIT, cbub: str | None = None) -> DataFrame:
    """Alignments of a BAM file; rec_no is the number of the record from 0, partitions are byte ranges of about ``split`` bytes.

    ``cbub``: adds has_tags, cb_idx and umi of the tag stream's record at the same place. A stream that ends before the alignments do is an
    error, and so are records that are left over, unless ``max_records`` ends the alignments. No shuffle: a partition reads the same records of both files.
    """
    register(spark)
    path = stores.qualified(spark, path)
    parts, left = [], max_records or (1 << 62)
    index = bam_index(spark, path, split)
    for place, first, n in index:
        if left > 0:
            parts.append([*place, first, min(n, left)])
            left -= n
    held = sum(p[3] for p in parts)
    options = {"parts": json.dumps(parts)}
    if cbub:
        cbub = stores.qualified(spark, cbub)
        there = CbubReader({"path": cbub}).header()[3]
        if there < held:
            raise ValueError(f"the tag stream ends before the alignments do: {there} records for {held}")
        if there > held and held == sum(n for *_, n in index):
            raise ValueError(f"the tag stream has {there - held} records left over")
        options["cbub"] = cbub
    return spark.read.format("tally_bam").options(**options).load(path)


class BamSource(DataSource):
    """spark.read.format("tally_bam").load(path): records in file order, rec_no from 0 in one partition; read_bam() gives the options for several.

    Options: parts, a list of [block, skip, number of the first record, records] for each partition; cbub, a tag stream to read beside (see read_bam()); max_records.
    """

    @classmethod
    def name(cls) -> str:
        return "tally_bam"

    def schema(self) -> str:
        return f"{SCHEMA}, has_tags boolean, cb_idx long, umi string" if "cbub" in self.options else SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return BamReader(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.path, self.limit, self.cbub = options["path"], int(options.get("max_records", 0)), options.get("cbub")
        self.parts = json.loads(options.get("parts", "null"))

    def partitions(self) -> list[Part]:
        return [Part(None)] if self.parts is None else [Part(p) for p in self.parts]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        block, skip, first, n = partition.value or (0, 0, 0, self.limit or 1 << 62)
        with stores.opened(self.path) as f:
            content = Content(f, block)
            if partition.value is None:
                header(content)
            else:
                content.take(skip)
            rows = batches(iter(content.record, None), first, n)
            if self.cbub is None:
                yield from rows
                return
            stream = CbubReader({"path": self.cbub})
            for b in rows:
                tags = stream.span(b.column("rec_no")[0].as_py(), len(b))
                yield pa.RecordBatch.from_arrays([*b.columns, *tags[1:]], schema=pa.schema([*BAM_FIELDS, *list(CBUB_FIELDS)[1:]]))


SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
LETTERS = "=ACMGRSVTWYHKDBN"


def tags_of(data: bytes) -> dict[str, str]:
    """Auxiliary fields; arrays are passed over."""
    out, at = {}, 0
    while at + 3 <= len(data):
        key, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[key], at = data[at:end].decode(), end + 1
        elif kind == "B":
            n = struct.unpack_from("<I", data, at + 1)[0]
            at += 5 + n * SIZES[chr(data[at])]
        else:
            value = struct.unpack_from("<" + {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H"}.get(kind, kind), data, at)[0]
            out[key], at = value.decode() if kind == "A" else str(value), at + SIZES[kind]
    return out


def parsed(n: int, r: bytes) -> dict:
    _, _, name, mapq, _, cigar, flag, length = struct.unpack_from("<iiBBHHHi", r)
    at = 32 + name + 4 * cigar
    packed = r[at : at + (length + 1) // 2]
    seq = "".join(LETTERS[b >> 4] + LETTERS[b & 15] for b in packed)[:length]
    tags = tags_of(r[at + len(packed) + length :])
    return {"rec_no": n, "qname": r[32 : 32 + name - 1].decode(), "flag": flag, "mapq": mapq, "seq": seq, "tags": list(tags.items()), "nh": int(tags["NH"]) if "NH" in tags else None}


def batches(source: Iterator[bytes], first: int, limit: int, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows = []
    for n, r in enumerate(source):
        if n >= limit:
            break
        rows.append(parsed(first + n, r))
        if len(rows) == size:
            yield pa.RecordBatch.from_pylist(rows, BAM_FIELDS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, BAM_FIELDS)


class CbubSource(DataSource):
    """spark.read.format("tally_cbub").load(path): the tag bit-stream, split by whole records. Option partitions.

    Header: four little-endian u64: status bits (1), barcode bits (1 to 32), UMI bits (even, up to 64), number of records. A record is
    ceil(bits / 8) bytes, lowest bit first: status, barcode index, UMI with its last base first.
    """

    @classmethod
    def name(cls) -> str:
        return "tally_cbub"

    def schema(self) -> str:
        return CBUB_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return CbubReader(self.options)


class CbubReader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.path, self.parts = options["path"], int(options.get("partitions", 8))

    def header(self) -> tuple[int, int, int, int]:
        with stores.opened(self.path) as f:
            head = f.read(32)
            if len(head) < 32:
                raise ValueError("the tag stream is cut off")
            status, cb, umi, n = struct.unpack("<4Q", head)
        if status != 1 or not 1 <= cb <= 32 or umi % 2 or not 0 < umi <= 64 or not n:
            raise ValueError("bad tag stream header")
        return status, cb, umi, n

    def partitions(self) -> list[Part]:
        n = self.header()[3]
        step = -(-n // self.parts)
        return [Part((a, min(a + step, n))) for a in range(0, n, step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        a, b = partition.value
        for first in range(a, b, 100_000):
            yield pa.RecordBatch.from_arrays(self.span(first, min(100_000, b - first)), schema=CBUB_FIELDS)

    def span(self, first: int, n: int) -> list[pa.Array]:
        """Columns of ``n`` records."""
        _, cb, umi, _ = self.header()
        size = -(-(1 + cb + umi) // 8)
        with stores.opened(self.path) as f:
            f.seek(32 + first * size)
            raw = np.frombuffer(f.read(n * size), np.uint8)
        if len(raw) < n * size:
            raise ValueError("the tag stream is cut off")
        bits = np.unpackbits(raw.reshape(n, size), axis=1, bitorder="little").astype(np.int64)
        index = bits[:, 1 : 1 + cb] @ (np.int64(1) << np.arange(cb))
        two = bits[:, 1 + cb : 1 + cb + umi].reshape(n, -1, 2)
        bases = np.frombuffer(b"ACGT", "S1")[(two[:, :, 0] + 2 * two[:, :, 1])[:, ::-1]]
        return [pa.array(np.arange(first, first + n)), pa.array(bits[:, 0] > 0), pa.array(index), pa.array([b.tobytes().decode() for b in bases])]


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    spark.dataSource.register(BamSource)
    spark.dataSource.register(CbubSource)


def read_cbub(spark: SparkSession, path: str) -> DataFrame:
    """The whole tag stream."""
    register(spark)
    return spark.read.format("tally_cbub").load(stores.qualified(spark, path))
