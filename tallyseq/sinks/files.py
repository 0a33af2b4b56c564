"""Outputs: coordinate matrices, lists, statistics, reports. Tables are written by Spark; only bounded reports pass the driver.

Paths are those of Spark's file systems, so a store that Spark writes will do.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from itertools import accumulate
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tallyseq.functions import dna
from tallyseq.operators import qc
from tallyseq.operators.barcode import small
from tallyseq.operators.common import release
from tallyseq.sources import files, stores

MATRIX_HEAD = "%%MatrixMarket matrix coordinate integer general\n%\n"
# Heads and line of the sequence and histogram tables.
SEQUENCES_HEAD = "Feature Index Sequence Hamming Distance Counts Match Position Feature Name\n"
SEQUENCES_LINE = "%7d %s %2d %7d %5d %s"
HISTOGRAM_HEAD = "FeatureName\tDedupedCount\tFrequency\n"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


@contextmanager
def stream(spark: SparkSession, path: str) -> Iterator:
    """Output stream of a file system of Spark's; write() takes bytearrays."""
    fs, where = _path(spark, path)
    out = fs.create(where, True)
    try:
        yield out
    finally:
        out.close()


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """A bounded report as one file."""
    with stream(spark, path) as out:
        out.write(bytearray(text.encode()))


def part_files(spark: SparkSession, directory: str) -> list[str]:
    """The part files that Spark wrote to a directory, in order."""
    if plain := stores.local(stores.qualified(spark, directory)):
        return [f"file:{plain}/{n}" for n in sorted(os.listdir(plain)) if n.startswith("part-")]
    fs, where = _path(spark, directory)
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))


def assembled(spark: SparkSession, targets: dict[str, tuple[bytes, list[str]]], packed: bool = False) -> None:
    """Files of a head and part files in order, for tools that read single files. Bytes go from file to file on executors; the parts stay.

    ``packed``: the parts are gzip, and the files hold their content. On a local or mounted file system each part is a task, which writes at the place that the sizes of the parts before it give; stores without writes at a place get
    one task a file. Stores that only Spark opens are written as streams, one after another. A file appears under its name when it is whole.
    """
    plan = []
    placed = {p: stores.local(stores.qualified(spark, p)) for p in targets}
    if packed:  # where the last part ends does not matter
        sizes = contents(spark, [p for path, (_, parts) in targets.items() if placed[path] for p in parts[:-1]])
    else:
        sizes = {p: stores.size_of(p) for path, (_, parts) in targets.items() if placed[path] for p in parts[:-1]}
    for path, (head, parts) in targets.items():
        where = stores.qualified(spark, path)
        if plain := placed[path]:
            os.makedirs(os.path.dirname(plain), exist_ok=True)
            with open(f"{plain}.tmp", "wb") as made:
                made.write(head)
            starts = accumulate([len(head), *(sizes[p] for p in parts[:-1])])
            plan += [(f"{where}.tmp", start, [p], b"", packed) for p, start in zip(parts, starts, strict=False)]
        elif not stores.opens(where):
            with stream(spark, f"{where}.tmp") as out:
                out.write(bytearray(head))
                for part in parts:
                    held, place = _path(spark, part)
                    given = held.open(place)
                    given = spark._jvm.java.util.zip.GZIPInputStream(given) if packed else given
                    try:
                        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, 1 << 20, False)
                    finally:
                        given.close()
        else:
            plan.append((f"{where}.tmp", -1, parts, head, packed))
    if plan:
        stores.on_executors(spark, plan, "path string, start long, parts array<string>, head binary, packed boolean", copied, "path string, start long, written long")
    for path in targets:
        where = stores.qualified(spark, path)
        if plain := stores.local(where):
            os.replace(f"{plain}.tmp", plain)
            with suppress(FileNotFoundError):  # the sum of a file that stood there before
                os.remove(os.path.join(os.path.dirname(plain), f".{os.path.basename(plain)}.crc"))
            continue
        fs, at = _path(spark, where)
        fs.delete(at, False)
        if stores.opens(where):
            stores.placed(where)[0].move(stores.placed(f"{where}.tmp")[1], stores.placed(where)[1])
        else:
            fs.rename(_path(spark, f"{where}.tmp")[1], at)


def content(path: str, packed: bool) -> Iterator[bytes]:
    """What a file holds, in pieces; of gzip files what they were made of."""
    with stores.opened(path) as raw:
        given = pa.CompressedInputStream(raw, "gzip") if packed and raw.size() else raw
        while data := given.read(1 << 20):
            yield data


def contents(spark: SparkSession, parts: list[str]) -> dict[str, int]:
    """Bytes that gzip files were made of, counted on executors: what stands at their end tells it up to 4 GB only."""
    if not parts:
        return {}
    return dict(stores.on_executors(spark, [(p,) for p in parts], "path string", lambda row: (row[0], sum(map(len, content(row[0], True)))), "path string, held long"))


def copied(row: tuple) -> tuple[str, int, int]:
    """Copies what part files hold to a place in a file that is there, or (-1) to a new file after a head."""
    path, start, parts, head, packed = row
    fs, at = stores.placed(path)
    written = 0
    if start < 0:
        with fs.open_output_stream(at) as out:
            out.write(head)
            for part in parts:
                for data in content(part, packed):
                    written += out.write(data)
        return path, start, written
    file = os.open(at, os.O_WRONLY)
    try:
        for part in parts:
            for data in content(part, packed):
                written += os.pwrite(file, data, start + written)
    finally:
        os.close(file)
    return path, start, written


def merged(spark: SparkSession, head: str, directory: str, path: str, packed: bool = False) -> None:
    """One file of ``head`` and the part files (``packed``: gzip) of a directory."""
    assembled(spark, {path: (head.encode(), part_files(spark, directory))}, packed)


class BytesSink(DataSource):
    """Format tally_bytes: the values of the one column data, partition by partition, as part files of a directory."""

    @classmethod
    def name(cls) -> str:
        return "tally_bytes"

    def schema(self) -> str:
        return "data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return BytesWriter(self.options["path"])


class BytesWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        name, final = f"try-{context.taskAttemptId()}", f"part-{context.partitionId():06d}"
        fs, at = stores.placed(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}") as out:
            for b in iterator:
                for x in b.column("data"):
                    out.write(x.as_py())
        message = WriterCommitMessage()
        message.names = name, final
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = stores.placed(self.path)
        for m in messages:
            fs.move(f"{at}/{m.names[0]}", f"{at}/{m.names[1]}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = stores.placed(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{at}/{m.names[0]}")


def write_bytes(rows: DataFrame, path: str, *order: str, head: bytes = b"") -> None:
    """``rows(data, ...)`` by ``order`` as one binary file, from sorted parts in <path>.parts, which are written anew."""
    spark = rows.sparkSession
    spark.dataSource.register(BytesSink)
    fs, where = _path(spark, f"{path}.parts")
    fs.delete(where, True)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ranged.select("data").write.format("tally_bytes").mode("append").save(stores.qualified(spark, f"{path}.parts"))
    assembled(spark, {path: (head, part_files(spark, f"{path}.parts") if fs.exists(where) else [])})


def write_lines(lines: DataFrame, path: str, *order: str, head: str = "") -> None:
    """``lines(value, ...)`` by ``order`` as one file, from sorted parts in <path>.parts, which are gzip, so that the text stands on the disk once. Before it is put together, the sort's shuffle files may go."""
    (lines.orderBy(*order) if order else lines).select("value").write.mode("overwrite").options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).text(f"{path}.parts")
    release(lines.sparkSession)
    merged(lines.sparkSession, head, f"{path}.parts", path, packed=True)


def write_matrix(cells: DataFrame, features: int, directory: str, suffix: str = "txt") -> None:
    """MatrixMarket file matrix.mtx of ``cells(barcode, feature_index, umis)``, and barcodes.<suffix>.

    Rows are features, columns barcodes by name, both from 1. Spark writes sorted parts to matrix, barcodes and header, which are put one after another.
    """
    spark = cells.sparkSession
    names = qc.numbered(cells.select("barcode").distinct(), "barcode", "column")
    placed = cells.join(names, "barcode").select("column", "feature_index", F.concat_ws(" ", "feature_index", "column", "umis").alias("value"))
    placed.repartitionByRange("column").sortWithinPartitions("column", "feature_index").select("value").write.mode("overwrite").text(f"{directory}/matrix")
    names.repartitionByRange("column").sortWithinPartitions("column").select("barcode").write.mode("overwrite").text(f"{directory}/barcodes")
    sizes = cells.agg(F.count_distinct("barcode").alias("b"), F.count("*").alias("n")).first()
    head = f"{MATRIX_HEAD}{features} {sizes['b']} {sizes['n']}"
    spark.createDataFrame([(head,)], "value string").write.mode("overwrite").text(f"{directory}/header")
    merged(spark, "", f"{directory}/barcodes", f"{directory}/barcodes.{suffix}")
    merged(spark, f"{head}\n", f"{directory}/matrix", f"{directory}/matrix.mtx")  # last: a folder that holds it is whole


def write_features(features: DataFrame, directory: str, name: str = "name", index: str = "feature_index", suffix: str = "txt") -> None:
    write_lines(features.select(F.col(name).alias("value"), index), f"{directory}/features.{suffix}", index)


def write_stats(stats: DataFrame, directory: str) -> None:
    """name<TAB>value lines of a one-row frame."""
    pairs = F.explode(F.array(*[F.concat(F.lit(f"{c}\t"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in stats.columns]))
    stats.select(pairs.alias("value")).write.mode("overwrite").text(f"{directory}/stats")


def write_run_stats(stats: DataFrame, cells: DataFrame, excluded: int, path: str) -> None:
    """The eight lines of stats.txt from qc.run_stats() and the written cells."""
    put_text(stats.sparkSession, stats_text(stats.first().asDict(), cells.select("barcode").distinct().count(), excluded), path)


def stats_text(s: dict, barcodes: int, excluded: int) -> str:
    # The labels of the statistics.
    lines = [
        ("Total feature counts", s["raw_counts"]), ("Total deduped feature counts", s["deduped_counts"]), ("Total barcodes", barcodes),
        ("Total excluded barcodes", excluded), ("Total unique barcode UMIs", s["unique_barcode_umis"]), ("Total whitelisted barcodes", s["whitelisted_barcodes"]),
        ("Total_unmatched_reads", s["unmatched_reads"]), ("Percentage reads assigned to barcode", f"{s['percent_assigned'] or 0:.4f}"),
    ]
    return "".join(f"{k} {v}\n" for k, v in lines)


def write_feature_sequences(sequences: DataFrame, features: DataFrame, path: str) -> None:
    """Matched sequences of match.feature_sequences(), differences from the feature in lower case; by feature, distance, count (falling), sequence."""
    write_lines(sequence_lines(sequences, features), path, *SEQUENCES_ORDER, head=SEQUENCES_HEAD)


SEQUENCES_ORDER = ("feature_index", "hamming", "fall", "matched_sequence")


def sequence_lines(sequences: DataFrame, features: DataFrame, *by: str) -> DataFrame:
    named = sequences.join(small(features.select("feature_index", "name", "sequence")), "feature_index")
    marked = dna.mark_differences(F.col("sequence"), F.col("matched_sequence"))
    line = F.format_string(SEQUENCES_LINE, F.col("feature_index").cast("int"), marked, F.col("hamming").cast("int"), F.col("n"), F.col("match_position").cast("int"), F.col("name"))
    return named.select(*by, line.alias("value"), "feature_index", "hamming", (-F.col("n")).alias("fall"), "matched_sequence")


def write_feature_per_cell(per_cell: DataFrame, path: str) -> None:
    columns = ["barcode", "num_features", "top_feature_index", "total_deduped_umi"]
    write_lines(per_cell.select(F.concat_ws(",", *columns).alias("value"), "barcode"), path, "barcode", head=",".join(columns) + "\n")


def write_histograms(histogram: DataFrame, features: DataFrame, path: str) -> None:
    """Name, deduplicated count and frequency, by feature and count, of qc.count_histogram()."""
    named = histogram.where("feature_index > 0 and frequency > 0").join(small(features.select("feature_index", "name")), "feature_index")
    write_lines(named.select(F.concat_ws("\t", "name", "umis", "frequency").alias("value"), "feature_index", "umis"), path, "feature_index", "umis", head=HISTOGRAM_HEAD)


def write_read_map(last: DataFrame, path: str) -> None:
    """qname, cb, ub, gene of demux.last_per_name(), by qname."""
    write_lines(last.select(F.concat_ws("\t", "qname", "cb", "ub", "gene").alias("value"), "qname"), path, "qname")


def write_probe_stats(stats: DataFrame, counts: DataFrame, probes: DataFrame, path: str) -> None:
    """Total and counted records, then the reads of each probe, those without any included."""
    s = stats.first()
    sums = counts.groupBy("probe_index").agg(F.sum("n").alias("n"))
    rows = small(probes.groupBy("probe_index").agg(F.min("probe_name").alias("name"))).join(sums, "probe_index", "left").select("probe_index", F.concat_ws("\t", "name", F.coalesce("n", F.lit(0))).alias("value"))
    # The labels of the statistics.
    write_lines(rows, path, "probe_index", head=f"Total_records\t{s['total_reads']}\nUsable_records\t{s['counted']}\nBC_ID\tTotal_reads\n")


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_samples(routed: DataFrame, path: str) -> None:
    """One gzip FASTQ file <sample group>/R<mate>.fastq.gz for each sample group and mate, R1, R2 and R3 in the same order.

    Rows are dealt by range of group, mate and read, so a large sample spreads over many tasks and a small one is in few; the parts of
    a file, which stay in <path>.parts, are gzip members one after another. ``routed`` is met twice, once for the ranges' bounds: give it stored.
    """
    spark = routed.sparkSession
    record = lambda m: F.struct(F.lit(m).alias("mate"), F.when(F.col(f"r{m}").isNotNull(), F.concat_ws("\n", f"r{m}.header", f"r{m}.seq", f"r{m}.plus", f"r{m}.qual")).alias("value"))
    rows = routed.select("sample_group", "read_id", F.explode(F.array(*map(record, (1, 2, 3)))).alias("x")).select("sample_group", "x.mate", "read_id", "x.value").where("value is not null")
    ordered = rows.repartitionByRange("sample_group", "mate", "read_id").sortWithinPartitions("sample_group", "mate", "read_id")
    ordered.select("sample_group", "mate", "value").write.mode("overwrite").partitionBy("sample_group", "mate").option("compression", "gzip").text(f"{path}.parts")
    assembled(spark, {f"{path}/{group}/R{mate}.fastq.gz": (b"", parts) for (group, mate), parts in parts_by_key(spark, f"{path}.parts").items()})


def parts_by_key(spark: SparkSession, directory: str) -> dict[tuple[str, ...], list[str]]:
    """Part files, in order, under the values of the columns by which a table was written."""
    root, out = stores.qualified(spark, directory), {}
    for path in files.find(root, "part-"):
        path = stores.qualified(spark, path)
        folders = path.removeprefix(root).strip("/").split("/")[:-1]
        out.setdefault(tuple(unquote(f.split("=", 1)[1]) for f in folders), []).append(path)
    return {k: sorted(v) for k, v in out.items()}


def write_by_sample(lines: DataFrame, root: str, name: str, samples: list[str], *order: str, heads: dict[str, str] | str = "") -> None:
    """``lines(sample, value, ...)`` by ``order`` as the file <root>/<sample>/<name> of each sample, from one range-dealt write into <root>/parts; ``heads``: the same for all, or one for each."""
    keys = ["sample", *order]
    ranged = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.select("sample", "value").write.mode("overwrite").partitionBy("sample").text(f"{root}/parts/{name}")
    parts = parts_by_key(lines.sparkSession, f"{root}/parts/{name}")
    head = lambda s: (heads if isinstance(heads, str) else heads[s]).encode()
    assembled(lines.sparkSession, {f"{root}/{s}/{name}": (head(s), parts.get((s,), [])) for s in samples})


def write_sidecar(hits: DataFrame, probes: int, path: str) -> None:
    """Binary sidecar: u64 total bytes, u8 probe count, then a byte for each record in order: its probe index, 0 for none.

    Each task of a range of rec_no makes its bytes as one part; see write_bytes().
    """
    if probes > 255:
        raise ValueError("the sidecar holds 255 probes at most")
    marks = hits.select("rec_no", F.coalesce("probe_index", F.lit(0)).cast("int").alias("p")).repartitionByRange("rec_no").sortWithinPartitions("rec_no").select("p")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column("p").to_numpy().astype("uint8").tobytes()], pa.binary())], names=["data"])

    write_bytes(marks.mapInArrow(pack, "data binary"), path, head=(hits.count() + 9).to_bytes(8, "little") + bytes([probes]))


def write_heatmap(cells: DataFrame, features: DataFrame, kept: DataFrame, path: str, title: str, kind: str) -> bool:
    """<path>.json and <path>.html of ``cells(feature_index, column, barcodes)`` for the features in ``kept``; False, and nothing written, if there are none."""
    names = {r["feature_index"]: r["name"] for r in features.select("feature_index", "name").collect()}
    chosen = {r["feature_index"] for r in kept.select("feature_index").collect()}
    rows = cells.join(small(kept.select("feature_index")), "feature_index", "left_semi").collect()
    return put_heatmap(cells.sparkSession, {(r["feature_index"], r["column"]): r["barcodes"] for r in rows}, names, chosen, path, title, kind)


def put_heatmap(spark: SparkSession, at: dict[tuple[int, int], int], names: dict[int, str], chosen: set[int], path: str, title: str, kind: str) -> bool:
    """The report of the cells ``at`` (feature, column).

    Columns run from 1 to the largest. ``kind`` coexpression: columns are numbers of features, whose sums count a barcode once for each,
    so they are divided by it; deduped_counts: columns are UMI counts. The report's size is features times columns, whatever the reads.
    """
    if not at:
        return False
    labels, columns = sorted(chosen), list(range(1, max(c for _, c in at) + 1))
    matrix = [[at.get((f, c), 0) for c in columns] for f in labels]
    sums = [sum(col) // (c if kind == "coexpression" else 1) for c, col in zip(columns, zip(*matrix, strict=True), strict=True)]
    report = {"title": title, "feature_labels": [names[f] for f in labels], "column_labels": columns, "column_sums": sums, "matrix": matrix, "type": kind, "num_features": len(names), "num_filtered_features": len(labels), "num_columns": len(columns)}
    put_text(spark, json.dumps(report), f"{path}.json")
    traces = [
        {"type": "bar", "x": columns, "y": sums, "yaxis": "y2"},
        {"type": "heatmap", "z": matrix, "x": columns, "y": report["feature_labels"], "zmin": 0, "zmax": max(map(max, matrix))},
    ]
    put_text(spark, page(traces, title, {"yaxis": {"domain": [0, 0.75]}, "yaxis2": {"domain": [0.8, 1]}}), f"{path}.html")
    return True


def page(traces: list[dict], title: str, layout: dict | None = None) -> str:
    """A page that draws Plotly traces when it is opened; what stands in titles and names cannot end the script."""
    safe = lambda x: json.dumps(x).replace("<", "\\u003c")
    heading = title.replace("&", "&amp;").replace("<", "&lt;")
    return f"<!doctype html><title>{heading}</title><div id=p></div><script src=https://cdn.plot.ly/plotly-2.35.2.min.js></script><script>Plotly.newPlot('p',{safe(traces)},{safe({'title': {'text': title}} | (layout or {}))})</script>"


def histogram_html(histogram: DataFrame, path: str, title: str) -> None:
    """Histogram of (value, frequency); the axis is rounded up to a multiple of five."""
    put_histogram(histogram.sparkSession, [(r["value"], r["frequency"]) for r in histogram.collect()], path, title)


def put_histogram(spark: SparkSession, rows: list[tuple[int, int]], path: str, title: str) -> None:
    top = max(5, -(-max((v for v, _ in rows), default=0) // 5) * 5)
    put_text(spark, page([{"type": "bar", "x": [v for v, _ in sorted(rows)], "y": [n for _, n in sorted(rows)]}], title, {"xaxis": {"range": [0, top]}}), path)


def ready(directory: str) -> bool:
    """Whether a folder holds a whole matrix, for runs that keep finished samples."""
    return exists(SparkSession.active(), f"{directory}/matrix.mtx")
