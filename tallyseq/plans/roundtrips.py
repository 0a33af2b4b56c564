"""Queries for sources and sinks: rows of a view are written as files to the shared folder and read back from there.

Each writes the whole view. Files of sources are written by Spark in the order of a key, so that line numbers are ranks of that key.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseq.operators import demux, match, qc
from tallyseq.operators.common import cut, shared_folder
from tallyseq.plans import programs
from tallyseq.plans.registry import ALLOWED, DESCRIBED, ROUTED, RUN_BY_SAMPLE, SPELLED, TOP, anchored, best_of, clique_sql, dedup, on_dedup, query, typed
from tallyseq.sinks import files as sinks
from tallyseq.sources import alignments, fastq, files, stores, tables

Col = F.col


def folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/roundtrip-{uuid.uuid4().hex}"


def stored(df: DataFrame, value: Column, *order: str, name: str = "rows", head: str = "") -> str:
    """Path of one text file of ``value`` by ``order``."""
    path = f"{folder(df)}/{name}"
    sinks.write_lines(df.withColumn("value", value), path, *order, head=head)
    return path


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), value of a written file of any size, read by its splits; empty lines are left out."""
    return fastq.numbered_lines(spark, [path]).where("value <> ''").select((Col("line") + 1).alias("line_no"), "value")


def fields(df: DataFrame, sep: str, **types: str) -> DataFrame:
    """Columns of lines. Casts are tried only: filters on them may meet the lines of a head before these go."""
    f = F.split("value", sep)
    return df.select(*[F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(types.items())])


# --- sources --------------------------------------------------------------------------------------------------------


def mates(r: DataFrame, where: str = "true", name: str = "a") -> tuple[str, str]:
    rows = r.where(where).select("read_id", F.concat(F.coalesce("barcode", F.lit("N" * 8)), "umi").alias("first"), F.lower("seq").alias("second"))
    record = lambda c: F.concat_ws("\n", F.concat(F.lit("@"), Col("read_id").cast("string")), c, F.lit("+"), F.repeat(F.lit("I"), F.length(c)))
    return stored(rows, record("first"), "read_id", name=f"{name}_R1_.fastq"), stored(rows, record("second"), "read_id", name=f"{name}_R2_.fastq")


FIRST = "concat(coalesce(barcode, 'NNNNNNNN'), umi)"


@query("fastq_pairs", f"select concat('L', cast(read_id % 2 as varchar(1))) as lane, row_number() over (partition by read_id % 2 order by read_id) - 1 as read_id, {FIRST} as r1_seq, lower(seq) as r2_seq, true as r3_missing from v_reads", "reads")
def fastq_pairs(r: DataFrame) -> DataFrame:
    """Two lanes of R1 and R2, paired by position."""
    sets = []
    for lane in (0, 1):
        r1, r2 = mates(r, f"read_id % 2 = {lane}", f"lane {lane}")
        sets.append({"sample": "s", "lane": f"L{lane}", "r1": r1, "r2": r2, "r3": None})
    return fastq.reads(fastq.read_fastq(r.sparkSession, sets)).select("lane", "read_id", "r1_seq", "r2_seq", Col("r3_seq").isNull().alias("r3_missing"))


@query("fastq_strict", f"select row_number() over (order by read_id) - 1 as read_id, concat('@', cast(read_id as varchar(20))) as header, {FIRST} as seq, '+' as plus, repeat('I', length({FIRST})) as qual from v_reads", "reads")
def fastq_strict(r: DataFrame) -> DataFrame:
    r1, r2 = mates(r)
    return fastq.read_fastq(r.sparkSession, [{"sample": "s", "lane": "0", "r1": r1, "r2": r2}], strict=True).select("read_id", "r1.*")


@query("fastq_side_by_side", f"select row_number() over (order by read_id) - 1 as read_id, {FIRST} as r1_seq, lower(seq) as r2_seq from v_reads", "reads")
def fastq_side_by_side(r: DataFrame) -> DataFrame:
    """The reader without a shuffle."""
    r1, r2 = mates(r)
    return fastq.reads(fastq.read_sets(r.sparkSession, [{"sample": "s", "lane": "0", "r1": r1, "r2": r2}], strict=True)).select("read_id", "r1_seq", "r2_seq")


@query("fastq_limit", f"select read_id, r1_seq, upper(substr(seq, 5, 8)) as kmer from (select row_number() over (order by read_id) - 1 as read_id, {FIRST} as r1_seq, seq from v_reads) where read_id < 700", "reads")
def fastq_limit(r: DataFrame) -> DataFrame:
    """The first reads of a file set (a limit is what this option is for), with an upper-cased k-mer."""
    r1, r2 = mates(r)
    rows = fastq.reads(fastq.read_fastq(r.sparkSession, [{"sample": "s", "lane": "0", "r1": r1, "r2": r2}], max_reads=700))
    return rows.select("read_id", "r1_seq", F.upper(F.substring("r2_seq", 5, 8)).alias("kmer"))


@query("whitelist_file", "select wl_idx, barcode, code, reverse(translate(barcode, 'ACGT', 'TGCA')) as reversed from v_whitelist", "whitelist")
def whitelist_file(w: DataFrame) -> DataFrame:
    """Each barcode stands twice in the file; the first line counts."""
    twice = w.select("barcode", "wl_idx").unionByName(w.select("barcode", (Col("wl_idx") + (1 << 40)).alias("wl_idx")))
    path = stored(twice, Col("barcode"), "wl_idx")
    turned = tables.whitelist(w.sparkSession, path, reverse=True).select("wl_idx", Col("barcode").alias("reversed"))
    return tables.whitelist(w.sparkSession, path).join(turned, "wl_idx").select("wl_idx", "barcode", "code", "reversed")


@query("feature_file", "select cast(feature_index as int) as feature_index, name, sequence, cast(length(sequence) as int) as length, pattern, cast(pattern_offset as int) as pattern_offset from v_features", "features")
def feature_file(f: DataFrame) -> DataFrame:
    return tables.features(f.sparkSession, stored(f, F.concat_ws(",", F.lit("x"), "pattern", "name", "sequence"), "feature_index", head="id,pattern,name,sequence\n"))


@query("barcode_file", f"select * from {ALLOWED}", "molecules")
def barcode_file(m: DataFrame) -> DataFrame:
    return tables.barcodes(m.sparkSession, stored(m.where("barcode < 'M'"), Col("barcode"), "barcode"))


def probe_file(p: DataFrame) -> str:
    """Probes by variant, after two lines that do not count."""
    return stored(p, F.concat_ws("\t", "variant", "variant", "probe_name"), "variant", head="ACGTNNNN ACGTACGT BC000\nshort short BC000\n")


@query("probe_file", "select variant, variant as canonical, probe_name, cast(row_number() over (order by variant) as int) as probe_index from v_probes", "probes")
def probe_variants(p: DataFrame) -> DataFrame:
    return tables.probes(p.sparkSession, probe_file(p))


@query("probe_file_grouped", "select variant, min(variant) over (partition by probe_name) as canonical, probe_name, cast(dense_rank() over (order by probe_name) as int) as probe_index from v_probes", "probes")
def probe_groups(p: DataFrame) -> DataFrame:
    return tables.probes(p.sparkSession, probe_file(p), grouped=True)


@query("sample_map_file", "select library_id, probe_name, replace(sample, ' ', '_') as sample from v_sample_map", "sample_map")
def sample_map_file(s: DataFrame) -> DataFrame:
    """Each key stands twice; the last line counts."""
    twice = s.select("library_id", "probe_name", F.lit("old").alias("sample"), F.lit(0).alias("k")).unionByName(s.withColumns({"sample": F.replace("sample", F.lit(" "), F.lit("_")), "k": F.lit(1)}))
    return tables.sample_map(s.sparkSession, stored(twice, F.concat_ws("\t", "library_id", "probe_name", "sample"), "k", "library_id", head="library probe sample\n"))


@query("file_sets", "select n_name as sample, cast(lane as varchar(2)) as lane, concat('/x/', n_name, '_L00', cast(lane + 1 as varchar(2)), '_R1_001.fastq') as r1, concat('/x/', n_name, '_L00', cast(lane + 1 as varchar(2)), '_R2_001.fastq') as r2 from (select replace(sample, ' ', '_') as n_name from v_sample_map) n, (select unnest(range(0, 2)) as lane) l", "sample_map")
def file_sets(s: DataFrame) -> DataFrame:
    """Comma lists of file names to samples and lanes. Names of files are few and planned on the driver."""
    names = sorted(r["sample"].replace(" ", "_") for r in s.collect())
    listed = [",".join(f"/x/{n}_L00{lane}_R{mate}_001.fastq" for n in names for lane in (1, 2)) for mate in (1, 2)]
    sets = programs.file_sets(r1=listed[0], r2=listed[1])
    return s.sparkSession.createDataFrame([(x["sample"], x["lane"], x["r1"], x["r2"]) for x in sets], "sample string, lane string, r1 string, r2 string")


@query("library_of_files", "select concat('/SC/x_', library_id, '_R1.fastq') as path, library_id from v_sample_map", "sample_map")
def library_of_files(s: DataFrame) -> DataFrame:
    return s.select(F.concat(F.lit("/SC/x_"), "library_id", F.lit("_R1.fastq")).alias("path")).withColumn("library_id", demux.library_id(Col("path")))


@query("sam_file", "select row_number() over (order by rec_no) - 1 as rec_no, qname, flag, mapq, seq, cb, ub, gene, nh from v_alignments", "alignments")
def sam_file(a: DataFrame) -> DataFrame:
    of = lambda t: F.try_element_at("tags", F.lit(t))
    return alignments.read_sam(a.sparkSession, sam_of(a)).select("rec_no", "qname", "flag", "mapq", "seq", of("CB").alias("cb"), of("UB").alias("ub"), of("GX").alias("gene"), "nh")


@query("sam_filtered", "select row_number() over (order by rec_no) - 1 as rec_no, qname, flag, mapq from v_alignments qualify flag & 3328 = 0 and mapq >= 5", "alignments")
def sam_filtered(a: DataFrame) -> DataFrame:
    """A filter on flag and quality meets the header lines, whose second field is no number."""
    return demux.usable(alignments.read_sam(a.sparkSession, sam_of(a)), 5).select("rec_no", "qname", "flag", "mapq")


def sam_of(a: DataFrame) -> str:
    tag = lambda t, c: F.concat(F.lit(f"{t}:Z:"), c)
    line = F.concat_ws("\t", "qname", "flag", F.lit("c1"), F.lit(1), "mapq", F.lit("*"), F.lit("*"), F.lit(0), F.lit(0), "seq", F.lit("*"), tag("CB", "cb"), tag("UB", "ub"), tag("GX", "gene"), F.concat(F.lit("NH:i:"), "nh"))
    return stored(a, line, "rec_no", name="rows.sam", head="@HD\tVN:1.6\n@SQ\tSN:c1\tLN:9\n")


def block(data: bytes) -> bytes:
    """A gzip member that tells its size."""
    z = zlib.compressobj(wbits=-15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def alignment_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: rows of the alignments view as blocks of alignment records."""
    base = {c: i for i, c in enumerate(alignments.LETTERS)}
    for b in batches:
        out = []
        for r in b.to_pylist():
            codes = [base[c] for c in r["seq"]] + [0] * (len(r["seq"]) % 2)
            packed = bytes(x << 4 | y for x, y in zip(codes[::2], codes[1::2], strict=True))
            aux = b"".join(t.encode() + b"Z" + r[c].encode() + b"\0" for t, c in (("CB", "cb"), ("UB", "ub"), ("GX", "gene")) if r[c] is not None) + b"NHi" + struct.pack("<i", r["nh"])
            body = struct.pack("<iiBBHHHiiii", 0, 0, len(r["qname"]) + 1, r["mapq"], 0, 1, r["flag"], len(r["seq"]), -1, -1, 0) + r["qname"].encode() + b"\0" + struct.pack("<I", len(r["seq"]) << 4) + packed + b"\xff" * len(r["seq"]) + aux
            out.append(struct.pack("<i", len(body)) + body)
        data = b"".join(out)
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(block(data[at : at + 60_000]) for at in range(0, len(data), 60_000))], pa.binary())], names=["data"])


def tag_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (has_tags, cb_idx, umi of six bases) as records of a tag stream with 16 bits of index."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            umi = 0
            for c in r["umi"]:
                umi = umi << 2 | "ACGT".index(c)
            out.append((int(r["has_tags"]) | r["cb_idx"] << 1 | umi << 17).to_bytes(4, "little"))
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["data"])


def bam_of(a: DataFrame) -> str:
    """Path of a BAM file of the alignments view."""
    path = f"{folder(a)}/rows.bam"
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 9)
    rows = a.select("rec_no", "qname", "flag", "mapq", "seq", "cb", "ub", "gene", "nh").repartitionByRange("rec_no").sortWithinPartitions("rec_no").drop("rec_no")
    sinks.write_bytes(rows.mapInArrow(alignment_blocks, "data binary"), path, head=block(head))
    return path


def stream_of(a: DataFrame) -> str:
    """Path of a tag stream beside bam_of(): no tags where the quality is a multiple of 4, an index of 1 to 1500, six bases of the read."""
    path = f"{folder(a)}/tags"
    tags = a.select("rec_no", (Col("mapq") % 4 != 0).alias("has_tags"), (Col("rec_no") % 1500 + 1).cast("long").alias("cb_idx"), F.substring("seq", 1, 6).alias("umi"))
    tags = tags.repartitionByRange("rec_no").sortWithinPartitions("rec_no").drop("rec_no")
    sinks.write_bytes(tags.mapInArrow(tag_records, "data binary"), path, head=struct.pack("<4Q", 1, 16, 12, a.count()))
    return path


def span(path: str) -> int:
    return max(1 << 18, files.size_of(path) // 512)


ALIGNED = 'select row_number() over (order by rec_no) - 1 as rec_no, qname, flag, mapq, seq, cb, ub, gene, nh'


@query("bam_file", f"{ALIGNED} from v_alignments", "alignments")
def bam_file(a: DataFrame) -> DataFrame:
    """A BAM file by ranges of 256 KB, larger ones by 512 ranges."""
    of = lambda t: F.try_element_at("tags", F.lit(t))
    path = bam_of(a)
    return alignments.read_bam(a.sparkSession, path, split=span(path)).select("rec_no", "qname", "flag", "mapq", "seq", of("CB").alias("cb"), of("UB").alias("ub"), of("GX").alias("gene"), "nh")


@query("bam_beside_tags", "select row_number() over (order by rec_no) - 1 as rec_no, qname, mapq % 4 <> 0 as has_tags, rec_no % 1500 + 1 as cb_idx, substr(seq, 1, 6) as umi from v_alignments", "alignments")
def bam_beside_tags(a: DataFrame) -> DataFrame:
    """A BAM file and a tag stream, record by record and without a shuffle."""
    path = bam_of(a)
    return alignments.read_bam(a.sparkSession, path, split=span(path), cbub=stream_of(a)).select("rec_no", "qname", "has_tags", "cb_idx", "umi")


@query("cbub_file", "select row_number() over (order by rec_no) - 1 as rec_no, mapq % 4 <> 0 as has_tags, rec_no % 1500 + 1 as cb_idx, substr(seq, 1, 6) as umi from v_alignments", "alignments")
def cbub_file(a: DataFrame) -> DataFrame:
    return alignments.read_cbub(a.sparkSession, stream_of(a))


# --- sinks ----------------------------------------------------------------------------------------------------------


@on_dedup("matrix_file", """select cast(feature_index as bigint) as feature_index, dense_rank() over (order by barcode) as "column", cast(umis as bigint) as umis, barcode from dedup
union all select 6, count(distinct barcode), count(*), 'head' from dedup""")
def matrix_file(m: DataFrame) -> DataFrame:
    """The size line and all entries of matrix.mtx, with the names of the columns."""
    path, spark = folder(m), m.sparkSession
    sinks.write_matrix(cut(dedup(m)), 6, path)
    head = fields(lines_of(spark, f"{path}/matrix.mtx").where("line_no = 3"), " ", feature_index="long", column="long", umis="long").withColumn("barcode", F.lit("head"))
    names = lines_of(spark, f"{path}/barcodes.txt").select(Col("line_no").alias("column"), Col("value").alias("barcode"))
    entries = lines_of(spark, f"{path}/matrix.mtx").where("line_no > 3")
    return fields(entries, " ", feature_index="long", column="long", umis="long").join(names, "column").unionByName(head)


@on_dedup("filtered_matrix_file", f'select feature_index, dense_rank() over (order by barcode) as "column", cast(umis as bigint) as umis from dedup where barcode in {ALLOWED}')
def filtered_matrix_file(m: DataFrame) -> DataFrame:
    path = f"{folder(m)}/filtered"
    sinks.write_matrix(cut(qc.semi(dedup(m), m.where("barcode < 'M'").select("barcode").distinct())), 6, path)
    return fields(lines_of(m.sparkSession, f"{path}/matrix.mtx").where("line_no > 3"), " ", feature_index="int", column="long", umis="long")


@on_dedup("feature_per_cell_file", "select barcode, count(*) as num_features, cast(case when count(*) filter (umis = top) = 1 then max(feature_index) filter (umis = top) else 0 end as int) as top_feature_index, cast(sum(umis) as bigint) as total_deduped_umi from (select *, max(umis) over (partition by barcode) as top from dedup) group by barcode")
def feature_per_cell_file(m: DataFrame) -> DataFrame:
    path = f"{folder(m)}/feature_per_cell.csv"
    sinks.write_feature_per_cell(qc.feature_per_cell(dedup(m)), path)
    return m.sparkSession.read.csv(path, header=True, schema="barcode string, num_features long, top_feature_index int, total_deduped_umi long")


def named(m: DataFrame) -> DataFrame:
    """Features of the molecules view."""
    return cut(m.select("feature_index", F.concat(F.lit("f"), "feature_index").alias("name")).distinct())


@on_dedup("histogram_file", "select concat('f', cast(feature_index as varchar(9))) as feature, umis, count(*) as frequency from dedup group by feature_index, umis")
def histogram_file(m: DataFrame) -> DataFrame:
    path = f"{folder(m)}/deduped_counts_histograms.txt"
    sinks.write_histograms(qc.count_histogram(dedup(m)), named(m), path)
    return fields(lines_of(m.sparkSession, path).where("line_no > 1"), "\t", feature="string", umis="long", frequency="long")


def report(m: DataFrame, cells: DataFrame, kept: DataFrame, kind: str) -> DataFrame:
    """Non-zero cells of a written report: feature, column, barcodes, column_sum."""
    path = f"{folder(m)}/heatmap"
    sinks.write_heatmap(cells, named(m), kept, path, kind, kind)
    text = m.sparkSession.read.text(f"{path}.json", wholetext=True)
    j = text.select(F.from_json("value", "feature_labels array<string>, column_labels array<long>, column_sums array<long>, matrix array<array<long>>").alias("j")).select("j.*")
    rows = j.select("column_labels", "column_sums", F.explode(F.arrays_zip("feature_labels", "matrix")).alias("x"))
    cell = rows.select(Col("x.feature_labels").alias("feature"), F.explode(F.arrays_zip("column_labels", Col("x.matrix").alias("n"), "column_sums")).alias("c"))
    return cell.select("feature", Col("c.column_labels").alias("column"), Col("c.n").alias("barcodes"), Col("c.column_sums").alias("column_sum")).where("barcodes > 0")


@on_dedup("heatmap_richness_file", """select concat('f', cast(feature_index as varchar(9))) as feature, richness as "column", count(*) as barcodes, cast(sum(count(*)) over (partition by richness) // richness as bigint) as column_sum
from (select *, count(*) over (partition by barcode) as richness from dedup) group by feature_index, richness""")
def heatmap_richness_file(m: DataFrame) -> DataFrame:
    d = cut(dedup(m))
    return report(m, qc.feature_richness(d).withColumnRenamed("richness", "column"), d.select("feature_index").distinct(), "coexpression")


@on_dedup("heatmap_counts_file", """select concat('f', cast(feature_index as varchar(9))) as feature, umis as "column", count(*) as barcodes, cast(sum(count(*)) over (partition by umis) as bigint) as column_sum
from dedup where feature_index in (select feature_index from dedup group by feature_index having sum(umis) > 1) group by feature_index, umis""")
def heatmap_counts_file(m: DataFrame) -> DataFrame:
    """All UMI counts up to the largest, without a last column for the rest."""
    d = cut(dedup(m))
    counts = qc.count_histogram(d).where("feature_index > 0").select("feature_index", Col("umis").alias("column"), Col("frequency").alias("barcodes"))
    return report(m, counts, qc.heatmap_rows(d), "deduped_counts")


@query("feature_sequences_file", f"""with {SPELLED}, {anchored('hit', '4', 1)}, best as ({best_of('hit')}), grouped as (select matched_sequence, count(*) as n, arg_min(feature_index, read_id) as feature_index, arg_min(hamming, read_id) as hamming, arg_min(match_position, read_id) as position from best group by matched_sequence)
select cast(g.feature_index as int) as feature_index, (select string_agg(case when substr(f.sequence, cast(i.i as int), 1) = substr(g.matched_sequence, cast(i.i as int), 1) then substr(g.matched_sequence, cast(i.i as int), 1) else lower(substr(g.matched_sequence, cast(i.i as int), 1)) end, '' order by i.i) from (select unnest(range(1, 21)) as i) i) as marked,
cast(g.hamming as int) as hamming, g.n, cast(g.position as int) as match_position, f.name from grouped g join v_features f on f.feature_index = g.feature_index""", "reads", "features")
def feature_sequences_file(r: DataFrame, f: DataFrame) -> DataFrame:
    path = f"{folder(r)}/feature_sequences.txt"
    sinks.write_feature_sequences(match.feature_sequences(typed(match.fuzzy_at(r, f, 4, 1))), f, path)
    rows = lines_of(r.sparkSession, path).where("line_no > 1").withColumn("value", F.btrim("value"))
    return fields(rows, " +", feature_index="int", marked="string", hamming="int", n="long", match_position="int", name="string")


@query("sample_files", f"with {ROUTED} select replace(sample_group, ' ', '_') as sample_group, m.m as mate, row_number() over (partition by sample_group, m.m order by routed.read_id) as place, routed.read_id, routed.seq from routed, (values (1), (2)) m(m)", "library_reads", "probes", "sample_map")
def sample_files(r: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    """Records of the FASTQ file of each sample and mate, in the order of the file."""
    path, spark = folder(r), r.sparkSession
    routed = demux.route(demux.probe_of(r, p, 2), s.withColumn("sample", F.replace("sample", F.lit(" "), F.lit("_"))))
    mate = F.struct(F.concat(F.lit("@"), Col("read_id").cast("string")).alias("header"), "seq", F.lit("+").alias("plus"), F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    sinks.write_samples(programs.kept(routed.withColumns({"r1": mate, "r2": mate, "r3": F.when(F.lit(False), mate)})), path)
    found = [x for m in (1, 2) for x in files.find(path, f"R{m}.fastq.gz")]
    sets = [{"sample": x, "lane": "0", "r1": x} for x in found]
    rows = fastq.read_any(spark, sets)
    name = F.regexp_extract("sample", r".*/roundtrip-[^/]+/(.*)/R([12])\.fastq\.gz", 1), F.regexp_extract("sample", r"R([12])\.fastq\.gz", 1).cast("int")
    return rows.select(name[0].alias("sample_group"), name[1].alias("mate"), (Col("read_id") + 1).alias("place"), F.substring("r1.header", 2, 30).cast(r.schema["read_id"].dataType).alias("read_id"), "r1.seq")


def demux_bam(a: DataFrame, p: DataFrame, file: str, **options) -> str:
    """Folder that the alignment program has written."""
    path = folder(a)
    programs.demux_bam(a.sparkSession, file, stored(p, F.concat_ws("\t", "variant", "variant", "probe_name"), "variant"), path, offset=2, min_mapq=5, **options)
    return path


FILES = """select 'matrix' as file, cast(probe as varchar(40)) as a, cast(dense_rank() over (order by cb) as varchar(40)) as b, cast(n as varchar(40)) as c from counts
union all select 'barcodes', cb, '', '' from (select distinct cb from counts) x
union all select 'stats', p.probe_name, cast(coalesce(sum(c.n), 0) as varchar(40)), '' from (select distinct probe_index, probe_name from v_probes) p left join counts c on c.probe = p.probe_index group by p.probe_index, p.probe_name
union all select 'stats', 'Total_records', cast(count(*) filter (complete) as varchar(40)), '' from described
union all select 'stats', 'Usable_records', cast(count(*) filter (counted) as varchar(40)), '' from described"""


def written(a: DataFrame, path: str) -> DataFrame:
    """Entries of the matrix, barcodes and statistics of the alignment program."""
    part = lambda name, keep, sep: fields(lines_of(a.sparkSession, f"{path}/{name}").where(keep), sep, a="string", b="string", c="string").na.fill("").select(F.lit(name.split(".")[0]).alias("file"), "a", "b", "c")
    return part("matrix.mtx", "line_no > 3", " ").unionByName(part("barcodes.tsv", "true", "\t")).unionByName(part("stats.txt", "line_no <> 3", "\t"))


@query("alignment_files", f"with {DESCRIBED}, counts as (select cb, probe, count(*) as n from described where counted group by cb, probe) {FILES}", "alignments", "probes")
def alignment_files(a: DataFrame, p: DataFrame) -> DataFrame:
    """The program over a BAM file."""
    return written(a, demux_bam(a, p, bam_of(a)))


@query("alignment_files_by_tags", f"""with {DESCRIBED.replace("v_alignments", "(select a.* exclude (cb, ub), coalesce(w.barcode, '-') as cb, 'x' as ub, mapq % 4 <> 0 as tags_there from v_alignments a left join v_whitelist w on w.wl_idx = a.rec_no % 1500 + 1)").replace("a.gene is not null", "(a.gene is not null and tags_there)")}, counts as (select cb, probe, count(*) as n from described where counted group by cb, probe) {FILES}""", "alignments", "probes", "whitelist")
def alignment_files_by_tags(a: DataFrame, p: DataFrame, w: DataFrame) -> DataFrame:
    """The same with barcodes and UMIs from a tag stream, whose indexes go beyond the whitelist."""
    return written(a, demux_bam(a, p, bam_of(a), cbub=stream_of(a), whitelist=stored(w, Col("barcode"), "wl_idx")))


@query("read_map_file", f"with {DESCRIBED} select qname, arg_max(cb, rec_no) as cb, arg_max(ub, rec_no) as ub, arg_max(gene, rec_no) as gene from described where counted group by qname", "alignments", "probes")
def read_map_file(a: DataFrame, p: DataFrame) -> DataFrame:
    path = demux_bam(a, p, sam_of(a), read_map=True)
    return fields(lines_of(a.sparkSession, f"{path}/read_to_cb_umi_gene.txt"), "\t", qname="string", cb="string", ub="string", gene="string")


@query("nh_debug_file", f"""with {DESCRIBED} select * from (select 'nh_staging' as event, row_number() over (order by rec_no) - 1 as "index", qname, cast(nh as int) as nh, cast(coalesce(probe, 0) as int) as "sampleIdx", cast(0 as bigint) as "cbIdxPlus1" from described where complete) where "index" < 1000
union all select 'nh_tap', row_number() over (order by rec_no) - 1, qname, cast(nh as int), cast(probe as int), 0 from described where counted""", "alignments", "probes")
def nh_debug_file(a: DataFrame, p: DataFrame) -> DataFrame:
    """The first 1000 complete records (a log with a limit) and all counted ones."""
    path = demux_bam(a, p, bam_of(a), nh_debug=True)
    staged = a.sparkSession.read.schema("event string, index long, qname string, meta_nh int, sampleIdx int, cbIdxPlus1 long").json(f"{path}/nh_staging.jsonl").withColumnRenamed("meta_nh", "nh")
    tap = lines_of(a.sparkSession, f"{path}/nh_tap.jsonl").select(F.from_json("value", "event string, qname string, nh int, sampleIdx int, cbIdxPlus1 long").alias("j"), (Col("line_no") - 1).alias("index"))
    return staged.unionByName(tap.select("j.event", "index", "j.qname", "j.nh", "j.sampleIdx", "j.cbIdxPlus1"))


@query("sidecar_file", f"with {DESCRIBED} select row_number() over (order by rec_no) as place, cast(coalesce(probe, 0) as int) as probe from described", "alignments", "probes")
def sidecar_file(a: DataFrame, p: DataFrame) -> DataFrame:
    """A byte for each record that passes the filters of flag and quality, in the order of the BAM file."""
    path, spark = stores.qualified(a.sparkSession, f"{demux_bam(a, p, bam_of(a), binary=True)}/probes.bin"), a.sparkSession
    spans = stores.ranges(stores.size_of(path), 1 << 20)
    return spark.createDataFrame(spans, "first long, end long").repartition(len(spans)).mapInArrow(marks_of(path), "place long, probe int")


def marks_of(path: str, head: int = 9) -> Callable:
    """mapInArrow function: byte ranges of a sidecar as places, from 1, and probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end in zip(b.column("first").to_pylist(), b.column("end").to_pylist(), strict=True):
                with stores.opened(path) as f:
                    f.seek(max(first, head))
                    held = np.frombuffer(f.read(max(0, end - max(first, head))), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)) + max(first, head) - head + 1), pa.array(held.astype(np.int32))], names=["place", "probe"])

    return run


# --- the assignment program -----------------------------------------------------------------------------------------

PROGRAM = f"""with recursive {SPELLED}, {anchored('hit', '4', 1)}, hits as ({best_of('hit')}), {RUN_BY_SAMPLE},
v_molecules as (select concat(r.event_type, '/', d.barcode) as barcode, d.umi, d.feature_index, count(*) as reads from done d join v_reads r on r.read_id = d.read_id where d.barcode is not null group by all),
{clique_sql()}, dedup as (select split_part(barcode, '/', 1) as sample, split_part(barcode, '/', 2) as barcode, feature_index, count(*) as umis from ({TOP.format(s=1)}) group by all),
n as (select event_type as sample, count(*) filter (h.read_id is null) as unmatched from v_reads r left join hits h on h.read_id = r.read_id group by event_type),
m as (select split_part(barcode, '/', 1) as sample, sum(reads) as raw, count(distinct barcode || umi) as pairs, count(distinct barcode) as listed from v_molecules group by 1),
c as (select sample, sum(umis) as umis, count(distinct barcode) as barcodes from dedup group by sample)"""
STATS = ("Total feature counts", "raw"), ("Total deduped feature counts", "umis"), ("Total barcodes", "barcodes"), ("Total excluded barcodes", "0"), ("Total unique barcode UMIs", "pairs"), ("Total whitelisted barcodes", "listed"), ("Total_unmatched_reads", "unmatched")
PERCENT = "select n.sample, 'stats', 'Percentage reads assigned to barcode', '', printf('%.4f', coalesce(100.0 * raw / (raw + unmatched), 0)) from n left join m on m.sample = n.sample"


def run_program(r: DataFrame, w: DataFrame, f: DataFrame, **options) -> str:
    """Folder that the assignment program has written from a pair of FASTQ files for each event type."""
    root, spark = folder(r), r.sparkSession
    record = lambda seq, qual: F.concat_ws("\n", F.concat(F.lit("@"), Col("read_id").cast("string")), seq, F.lit("+"), qual)
    first = record(F.concat(F.coalesce("barcode", F.lit("N" * 8)), "umi"), F.concat("barcode_qual", F.repeat(F.lit("I"), F.length("umi"))))
    rows = r.select(Col("event_type").alias("sample"), "read_id", first.alias("a"), record(Col("seq"), F.repeat(F.lit("I"), F.length("seq"))).alias("b"))
    rows, samples = cut(rows), sorted(x[0] for x in r.select("event_type").distinct().collect())
    for c, name in (("a", "x_R1_.fastq"), ("b", "x_R2_.fastq")):
        sinks.write_by_sample(rows.select("sample", "read_id", Col(c).alias("value")), f"{root}/in", name, samples, "read_id")
    names = stored(f, F.concat_ws(",", "name", "sequence", "pattern"), "feature_index", head="name,sequence,pattern\n")
    programs.assign_barcodes(spark, stored(w, Col("barcode"), "wl_idx"), names, f"{root}/out", directory=f"{root}/in", barcode_length=8, umi_length=5, min_counts=0, max_n_barcode=2, strict=False, **options)
    return f"{root}/out"


def whole_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """sample, value: the text of a file of each sample."""
    paths = [p for p in files.find(root, name) if "/parts/" not in p]
    return spark.read.text(paths, wholetext=True).select(F.regexp_extract(Col("_metadata.file_path"), f"([^/]+)/{name}$", 1).alias("sample"), "value")


def of_samples(spark: SparkSession, root: str, name: str) -> DataFrame:
    """sample, line_no, value of a file of each sample."""
    text = whole_files(spark, root, name)
    return text.select("sample", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).withColumn("line_no", Col("line_no") + 1).where("value <> ''")


@query("assign_program", f"""{PROGRAM} select sample, 'matrix' as file, cast(feature_index as varchar(40)) as a, barcode as b, cast(umis as varchar(40)) as c from dedup
union all {" union all ".join(f"select n.sample, 'stats', '{label}', '', cast(cast(coalesce({c}, 0) as bigint) as varchar(40)) from n left join m on m.sample = n.sample left join c on c.sample = n.sample" for label, c in STATS)} union all {PERCENT}""", "reads", "whitelist", "features")
def assign_program(r: DataFrame, w: DataFrame, f: DataFrame) -> DataFrame:
    """From FASTQ files to matrix and statistics, all samples in the same jobs."""
    root, spark = run_program(r, w, f, offset=4, reach=0), r.sparkSession
    split = F.split("value", " ")
    entries = of_samples(spark, root, "matrix.mtx").where("line_no > 3").select("sample", split[0].alias("a"), split[1].cast("int").alias("column"), split[2].alias("c"))
    names = of_samples(spark, root, "barcodes.txt").select("sample", Col("line_no").alias("column"), Col("value").alias("b"))
    matrix = entries.join(names, ["sample", "column"]).select("sample", F.lit("matrix").alias("file"), "a", "b", "c")
    stats = of_samples(spark, root, "stats.txt").select("sample", F.lit("stats").alias("file"), F.regexp_extract("value", "^(.*) [^ ]+$", 1).alias("a"), F.lit("").alias("b"), F.regexp_extract("value", "([^ ]+)$", 1).alias("c"))
    return matrix.unionByName(stats)


@query("assign_program_reports", f"""{PROGRAM}, shown as (select * from dedup where feature_index > 0), kept as (select sample, feature_index from shown group by all having sum(umis) > 1), enough as (select sample from kept group by sample having count(*) > 1)
select sample, 'umis' as report, cast(umis as bigint) as x, cast(count(*) as bigint) as y from shown group by all
union all select sample, 'counts', cast(umis as bigint), cast(count(*) as bigint) from shown semi join kept using (sample, feature_index) semi join enough using (sample) group by all
union all select sample, 'features', richness, count(*) from (select sample, barcode, count(*) as richness from shown group by all) group by all""", "reads", "whitelist", "features")
def assign_program_reports(r: DataFrame, w: DataFrame, f: DataFrame) -> DataFrame:
    """Traces of the pages: the histogram of UMI counts, and the bars above both heatmaps."""
    root, spark = run_program(r, w, f, offset=4, reach=0), r.sparkSession
    out = None
    for report, page in (("umis", "umi_counts_histogram"), ("counts", "Feature_counts_heatmap"), ("features", "Feature_coexpression_heatmap")):
        text = whole_files(spark, root, f"{page}.html").select("sample", F.regexp_extract("value", r"newPlot\('p',(\[.*?\}\]),\{", 1).alias("traces"))
        bar = text.select("sample", F.from_json("traces", "array<struct<type:string,x:array<bigint>,y:array<string>>>")[0].alias("t"))
        rows = bar.select("sample", F.explode(F.arrays_zip("t.x", "t.y")).alias("p")).select("sample", F.lit(report).alias("report"), "p.x", F.col("p.y").cast("long").alias("y")).where("y > 0")
        out = rows if out is None else out.unionByName(rows)
    return out
