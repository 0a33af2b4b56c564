"""Paired FASTQ as DataFrames.

read_sets() reads the files of a set side by side, without a shuffle: an index of line counts by byte range says where each record lies, and each
partition holds the same records of all mates. Gzip files cannot be split, so a set with one is one partition. read_fastq() goes
through Spark's own text reader, for stores that only Spark opens: line numbers come from the reader's splits, and lines meet by record in a shuffle.
"""

from __future__ import annotations

import io
import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.window import Window

from tallyseq.sources import files, stores
from tallyseq.sources.stores import qualified

FIELDS = ("header", "seq", "plus", "qual")


def numbered_lines(spark: SparkSession, paths: list[str], kept: Column | None = None) -> DataFrame:
    """path, line (from 0), value; with ``kept`` only lines for which it holds, numbered among themselves."""
    text = spark.read.text(paths)
    raw = (text if kept is None else text.where(kept)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(F.broadcast(splits), ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("line"), "value")


def unique(file_sets: list[dict]) -> None:
    """An error where a sample has a lane twice: reads of the two could not be told apart."""
    if twice := [k for k, n in Counter((s["sample"], s["lane"]) for s in file_sets).items() if n > 1]:
        raise ValueError(f"sample and lane stand for several file sets: {twice[0]}")


def shares(spark: SparkSession, paths: list[str], split: int = 8 << 20) -> int:
    """Shuffle partitions for the lines of files, about ``split`` bytes each (gzip files are taken as a fifth of their content), at least as many as the session's."""
    size = sum(files.size_of(p) * (5 if p.endswith(".gz") else 1) for p in paths)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // split))


def read_fastq(spark: SparkSession, file_sets: list[dict], strict: bool = False, max_reads: int = 0) -> DataFrame:
    """sample, lane, read_id (from 0 in its file set), r1, r2, r3 (struct of header, seq, plus, qual; null for absent files).

    ``file_sets``: dicts with sample, lane and paths r1, r2, r3 (two at least of the three may be missing). Files of a set are paired by position. A record that
    one of the files lacks, or holds in part, ends the set: it is dropped, with all after it; ``strict`` makes it an error. ``max_reads``: the first so
    many of each file set, 0 for all.
    """
    unique(file_sets)
    rows = [(s["sample"], s["lane"], i, qualified(spark, s[f"r{i}"])) for s in file_sets for i in (1, 2, 3) if s.get(f"r{i}")]
    keyed = spark.createDataFrame(rows, "sample string, lane string, mate int, name string")
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    lines = numbered_lines(spark, [r[3] for r in rows]).withColumn("name", F.regexp_replace(decoded, "^file:/+", "file:/"))
    mates = keyed.groupBy("sample", "lane").agg(F.count("*").alias("files"))
    parts = lines.join(F.broadcast(keyed), "name").withColumn("read_id", F.floor(F.col("line") / 4)).withColumn("part", (F.col("line") % 4).cast("int"))
    if max_reads:
        parts = parts.where(F.col("read_id") < max_reads)
    value = lambda m, p: F.max(F.when((F.col("mate") == m) & (F.col("part") == p), F.col("value")))
    # no sort of a split's lines, and tasks of bounded size: lines go to their record as they are
    parts = parts.select("sample", "lane", "read_id", "mate", "part", "value").repartition(shares(spark, [r[3] for r in rows]), "sample", "lane", "read_id")
    records = parts.groupBy("sample", "lane", "read_id").agg(F.count("*").alias("have"), *[value(m, p).alias(f"r{m}_{f}") for m in (1, 2, 3) for p, f in enumerate(FIELDS)]).join(F.broadcast(mates), ["sample", "lane"])
    whole = F.col("have") == 4 * F.col("files")
    records = records.withColumn("read_id", F.when(whole, F.col("read_id")).otherwise(F.raise_error(F.lit("files of a set differ in length, or a record is cut off")))) if strict else records.where(whole)
    mate = lambda m: F.when(F.col(f"r{m}_seq").isNotNull(), F.struct(*[F.col(f"r{m}_{f}").alias(f) for f in FIELDS])).alias(f"r{m}")
    return records.select("sample", "lane", F.col("read_id").cast("long").alias("read_id"), *[mate(m) for m in (1, 2, 3)])


def reads(records: DataFrame) -> DataFrame:
    """Sequences and qualities only: sample, lane, read_id, r1_seq, r1_qual, r2_seq, r2_qual, r3_seq, r3_qual."""
    return records.select("sample", "lane", "read_id", *[F.col(f"r{m}.{f}").alias(f"r{m}_{f}") for m in (1, 2, 3) for f in ("seq", "qual")])


MATE = pa.struct([(f, pa.string()) for f in FIELDS])
RECORDS = pa.schema([("sample", pa.string()), ("lane", pa.string()), ("read_id", pa.int64()), ("r1", MATE), ("r2", MATE), ("r3", MATE)])


def gzipped(path: str) -> bool:
    with stores.opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


def lines_from(path: str, byte: int, skip: int) -> Iterator[str]:
    """Lines of a file, gzip or plain, from the line that begins ``skip`` lines after a byte."""
    with stores.opened(path) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(byte)
        with io.TextIOWrapper(io.BufferedReader(pa.CompressedInputStream(raw, "gzip") if packed else raw, 1 << 20), newline="\n") as text:
            for _ in range(skip):
                text.readline()
            for line in text:
                yield line.rstrip("\r\n")


class FastqSource(DataSource):
    """Format tally_fastq: partitions of read_sets(), each with the same range of records of all mates. Option plan: see planned()."""

    @classmethod
    def name(cls) -> str:
        return "tally_fastq"

    def schema(self) -> str:
        mate = "struct<header string, seq string, plus string, qual string>"
        return f"sample string, lane string, read_id long, r1 {mate}, r2 {mate}, r3 {mate}"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.plan, self.strict, self.slim, self.batch = options["plan"], options["strict"] == "true", options["slim"] == "true", int(options.get("batch", 10_000))

    def partitions(self) -> list[stores.Part]:
        return [stores.Part(p) for p in json.loads(self.plan)]

    def read(self, partition: stores.Part) -> Iterator[pa.RecordBatch]:
        for p in partition.value:
            yield from self.read_range(p)

    def read_range(self, p: dict) -> Iterator[pa.RecordBatch]:
        sources = {k: lines_from(*at) for k, at in p["mates"].items()}
        first, left, whole = p["first"], p["n"], True
        while whole and (left is None or left > 0):
            want = self.batch if left is None else min(self.batch, left)
            lines = {k: list(islice(source, 4 * want)) for k, source in sources.items()}
            have = min(len(x) for x in lines.values()) // 4
            whole = have == want
            if not whole and self.strict and any(len(x) != 4 * have for x in lines.values()):
                raise ValueError("files of a set differ in length, or a record is cut off")
            if have:
                yield self.records(p, first, have, lines)
            first, left = first + have, None if left is None else left - have

    def records(self, p: dict, first: int, n: int, lines: dict[str, list[str]]) -> pa.RecordBatch:
        def mate(k: str) -> pa.Array:
            if k not in lines:
                return pa.nulls(n, MATE)
            return pa.StructArray.from_arrays([pa.nulls(n, pa.string()) if self.slim and i % 2 == 0 else pa.array(lines[k][i : 4 * n : 4], pa.string()) for i in range(4)], fields=list(MATE))

        return pa.RecordBatch.from_arrays([pa.array([p["sample"]] * n), pa.array([p["lane"]] * n), pa.array(range(first, first + n), pa.int64()), *map(mate, ("r1", "r2", "r3"))], schema=RECORDS)


def packed(ranges: list[dict], split: int) -> list[list[dict]]:
    """Ranges by partition: small ones share one of about ``split`` bytes."""
    out: list[list[dict]] = []
    size = split
    for r in ranges:
        if size + r["bytes"] > split:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r["bytes"]
    return out


def planned(spark: SparkSession, file_sets: list[dict], strict: bool, max_reads: int, split: int) -> list[dict]:
    """Ranges of records: sample, lane, first record, number of records (None: to the end), bytes of the first mate and for each mate path, byte and lines to pass from there.

    Plain files are counted once, by byte range. A set's records are those that all mates hold whole; ``strict`` makes others an error.
    """
    unique(file_sets)
    mates = [{f"r{i}": qualified(spark, s[f"r{i}"]) for i in (1, 2, 3) if s.get(f"r{i}")} for s in file_sets]
    plain = [not any(map(gzipped, m.values())) for m in mates]
    index = stores.line_index(spark, [p for m, ok in zip(mates, plain, strict=True) if ok for p in m.values()], split) if any(plain) else {}
    out = []
    for s, m, ok in zip(file_sets, mates, plain, strict=True):
        head = {"sample": s["sample"], "lane": s["lane"]}
        if not ok:
            out.append(head | {"first": 0, "n": max_reads or None, "bytes": stores.size_of(next(iter(m.values()))), "mates": {k: [p, 0, 0] for k, p in m.items()}})
            continue
        held = [index[p][-1][1] for p in m.values()]
        if strict and not max_reads and (len(set(held)) > 1 or held[0] % 4):
            raise ValueError("files of a set differ in length, or a record is cut off")
        n = min(held) // 4
        n = min(n, max_reads) if max_reads else n
        marks = index[next(iter(m.values()))]
        edges = sorted({min(-(-lines // 4), n) for _, lines in marks} | {n})
        size = marks[-1][0] // max(1, len(edges) - 1)
        out += [head | {"first": a, "n": b - a, "bytes": size, "mates": {k: [p, *stores.place_of_line(index[p], 4 * a)] for k, p in m.items()}} for a, b in zip(edges, edges[1:], strict=False)]
    return out


def read_sets(spark: SparkSession, file_sets: list[dict], strict: bool = False, max_reads: int = 0, batch: int = 10_000, split: int = stores.SPLIT, slim: bool = False) -> DataFrame:
    """What read_fastq() gives, without a shuffle: each partition reads about ``split`` bytes of the first mate and the same records of the others.

    A set with a gzip file is read by one task; small sets share partitions. Paths are local, or those of a store that Arrow's file systems open. ``slim`` leaves header and plus null.
    """
    spark.dataSource.register(FastqSource)
    plan = packed(planned(spark, file_sets, strict, max_reads, split), split)
    return spark.read.format("tally_fastq").options(plan=json.dumps(plan), strict=str(strict).lower(), slim=str(slim).lower(), batch=batch).load()


def read_any(spark: SparkSession, file_sets: list[dict], strict: bool = False, max_reads: int = 0, slim: bool = False) -> DataFrame:
    """read_sets() where the store of all files can be opened on executors, read_fastq() where only Spark reads it; names and endings do not matter."""
    paths = [qualified(spark, p) for s in file_sets for p in (s.get("r1"), s.get("r2"), s.get("r3")) if p]
    if all(map(stores.opens, paths)):
        return read_sets(spark, file_sets, strict, max_reads, slim=slim)
    return read_fastq(spark, file_sets, strict, max_reads)
