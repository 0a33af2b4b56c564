"""The three programs from files to an output folder: one call each, with checks of the options before anything is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseq.operators import demux, match, molecules, qc
from tallyseq.operators.barcode import small
from tallyseq.operators.common import cut, shared_folder
from tallyseq.plans import assign
from tallyseq.sinks import files as sinks
from tallyseq.sources import alignments, fastq, files, tables

PATTERNS = ("_R1_", "_R2_", "_R3_")
LANE_BITS = 44
LANE_STEP = 1 << LANE_BITS  # reads of a lane


def file_sets(directory: str | None = None, r1: str = "", r2: str = "", r3: str = "", patterns: tuple[str, str, str] = PATTERNS, merge_all: bool = False) -> list[dict]:
    """File sets of a directory, or of comma lists of files. An error: both or neither, equal patterns, numbers of files that do not fit."""
    if len(set(patterns)) < 3:
        raise ValueError("the patterns of R1, R2 and R3 must differ")
    lists = [files.listed(x) for x in (r1, r2, r3)]
    if directory and any(lists):
        raise ValueError("a directory and lists of files exclude each other")
    if not directory and not any(lists):
        raise ValueError("a directory or lists of files are needed")
    return files.by_directory(directory, patterns) if directory else files.by_name(*lists, patterns[0], merge_all)


def checked(stringency: int, min_counts: int, m: int, min_posterior: float, max_reads: int) -> None:
    """An error for options out of their range."""
    for name, value, good in (("stringency", stringency, 0 <= stringency <= 1000), ("min_counts", min_counts, min_counts >= 0), ("m", m, m >= 0), ("min_posterior", min_posterior, 0 <= min_posterior <= 1), ("max_reads", max_reads, max_reads >= 0)):
        if not good:
            raise ValueError(f"{name} is out of range: {value}")


def searched(records: DataFrame, features: DataFrame, offset: int | str | None, m: int, max_n: int, reach: int) -> DataFrame:
    """Hits of all mates but the first, (read_id, feature_index, ...); where R2 and R3 are there, the closer of the two (see match.combine())."""
    of = lambda k: match.cascade(records.where(f"r{k}_seq is not null").select("read_id", F.col(f"r{k}_seq").alias("seq")), features, offset, m, max_n, reach)
    mates = [k for k in (2, 3) if records.where(f"r{k}_seq is not null").take(1)]
    if len(mates) == 2:
        return match.combine(of(2).withColumn("source", F.lit(0)).unionByName(of(3).withColumn("source", F.lit(1))))
    return of(mates[0] if mates else 2)


def assign_barcodes(
    spark: SparkSession, whitelist: str, features: str, out: str, directory: str | None = None, r1: str = "", r2: str = "", r3: str = "", patterns: tuple[str, str, str] = PATTERNS,
    merge_all: bool = False, offset: int | None = None, individual_offsets: bool = False, reach: int = -1, m: int = 1, max_n_feature: int = 3, barcode_start: int = 0, barcode_length: int = 16,
    umi_length: int = 12, stringency: int = 1, min_counts: int = 1, min_posterior: float = 0.975, max_reads: int = 0, reverse_whitelist: bool = False, filtered: str | None = None,
    keep_existing: bool = False, min_heatmap: int = -1, strict: bool = True, **options,
) -> list[str]:
    """Feature counts of every sample, each in its folder under ``out``; returns the folders that were written.

    R1 holds barcode and UMI from ``barcode_start``; R2 and R3 are searched for features. ``filtered``: a list of barcodes for a second
    output in the folder filtered. ``keep_existing`` leaves samples alone whose matrix is there. Options of other names go to assign.classed().
    All samples go through the same jobs, the sample being a part of each key; what Spark writes for them together stays in the folder parts.
    """
    checked(stringency, min_counts, m, min_posterior, max_reads)
    sets = file_sets(directory, r1, r2, r3, patterns, merge_all)
    if keep_existing:
        ready = {s for s in {x["sample"] for x in sets} if sinks.exists(spark, f"{out}/{s}/matrix.mtx")}
        sets = [s for s in sets if s["sample"] not in ready]
    samples = list(dict.fromkeys(s["sample"] for s in sets))
    dictionary = cut(tables.features(spark, features))
    at = match.constant_offset(dictionary, offset, individual_offsets)
    if not sets:
        return []
    cells = tables.whitelist(spark, whitelist, reverse_whitelist)
    allowed = cut(tables.barcodes(spark, filtered)) if filtered else None
    rows = fastq.reads(fastq.read_any(spark, [s | {"lane": str(i)} for i, s in enumerate(sets)], max_reads=max_reads, slim=True))
    part = lambda c, first, n: F.when(F.length("r1_seq") >= barcode_start + barcode_length + umi_length, F.substring(c, barcode_start + first + 1, n))
    reads = cut(rows.select("sample", (F.col("lane").cast("long") * LANE_STEP + F.col("read_id")).alias("read_id"), part("r1_seq", 0, barcode_length).alias("barcode"), part("r1_seq", barcode_length, umi_length).alias("umi"), part("r1_qual", 0, barcode_length).alias("barcode_qual"), "r2_seq", "r3_seq"))
    hits = cut(searched(reads, dictionary, at, m, max_n_feature, reach))
    by = ("sample",)
    settled = cut(assign.classed(reads, cells, dictionary, barcode_length, hits=hits, min_posterior=min_posterior, by=by, **options))
    # a cell is a barcode of a sample
    cell = F.concat("sample", F.lit("\t"), "corrected").alias("barcode")
    molecule = cut(molecules.molecule_counts(settled.where("corrected is not null").select("read_id", cell, "umi", "feature_index")))
    dedup = cut(molecules.dedup_counts(molecule, umi_length, stringency, min_counts, strict))
    raw = molecule.groupBy("barcode", "feature_index").agg(F.sum("reads").alias("n"))
    stats = cut(qc.run_stats(settled, of_sample(raw), of_sample(dedup), of_sample(molecule), by))
    lanes = spark.createDataFrame([(i, s["sample"]) for i, s in enumerate(sets)], "lane long, sample string")
    placed = hits.withColumn("lane", F.shiftright("read_id", LANE_BITS)).join(F.broadcast(lanes), "lane")  # a row for each file set
    sequences = cut(match.feature_sequences(placed, *by))
    write_samples(dedup, stats, sequences, dictionary, out, samples, "", {}, min_heatmap)
    if allowed is not None:
        left = of_sample(dedup).join(allowed.withColumnRenamed("barcode", "plain"), "plain", "left_anti").groupBy("sample").agg(F.count_distinct("plain").alias("n"))
        excluded = {r["sample"]: r["n"] for r in left.collect()}
        inside = cut(of_sample(dedup).join(allowed.withColumnRenamed("barcode", "plain"), "plain", "left_semi").select("barcode", "feature_index", "umis"))
        write_samples(inside, stats, sequences, dictionary, out, samples, "/filtered", excluded, min_heatmap)
    return [f"{out}/{s}" for s in samples]


def of_sample(df: DataFrame) -> DataFrame:
    """Adds sample and plain, the barcode without it."""
    return df.withColumns({"sample": F.substring_index("barcode", "\t", 1), "plain": F.substring_index("barcode", "\t", -1)})


def write_samples(dedup: DataFrame, stats: DataFrame, sequences: DataFrame, features: DataFrame, out: str, samples: list[str], inner: str, excluded: dict[str, int], min_heatmap: int = -1) -> None:
    """All files of all samples, in <out>/<sample><inner>: counts, lists, statistics, tables and reports; the matrices come last.

    Tables are written once for all samples and taken apart by sample; reports, whose size the features bound, pass the driver in one go.
    """
    spark = dedup.sparkSession
    folders = [f"{s}{inner}" for s in samples]
    tell = lambda lines: lines.withColumn("sample", F.concat("sample", F.lit(inner)))
    cells = of_sample(dedup)
    names = {r["feature_index"]: r["name"] for r in features.select("feature_index", "name").collect()}
    sinks.write_lines(features.select(F.col("name").alias("value"), "feature_index"), f"{out}/parts/features{inner}.txt", "feature_index")
    sinks.assembled(spark, {f"{out}/{f}/features.txt": (b"", [f"{out}/parts/features{inner}.txt"]) for f in folders})
    per_cell = of_sample(qc.feature_per_cell(dedup)).select("sample", F.concat_ws(",", "plain", "num_features", "top_feature_index", "total_deduped_umi").alias("value"), "plain")
    sinks.write_by_sample(tell(per_cell), out, "feature_per_cell.csv", folders, "plain", heads="barcode,num_features,top_feature_index,total_deduped_umi\n")
    sinks.write_by_sample(tell(sinks.sequence_lines(sequences, features, "sample")), out, "feature_sequences.txt", folders, *sinks.SEQUENCES_ORDER, heads=sinks.SEQUENCES_HEAD)
    histogram = cut(cells.groupingSets([["sample", "feature_index", "umis"], ["sample", "umis"]], "sample", "feature_index", "umis").agg(F.count("*").alias("frequency")).select("sample", F.coalesce("feature_index", F.lit(0)).alias("feature_index"), "umis", "frequency"))
    named = histogram.where("feature_index > 0").join(small(features.select("feature_index", "name")), "feature_index").select("sample", F.concat_ws("\t", "name", "umis", "frequency").alias("value"), "feature_index", "umis")
    sinks.write_by_sample(tell(named), out, "deduped_counts_histograms.txt", folders, "feature_index", "umis", heads=sinks.HISTOGRAM_HEAD)
    richness = cells.groupBy("barcode", "sample").agg(F.count("*").alias("column"), F.collect_list("feature_index").alias("fs")).select("sample", "column", F.explode("fs").alias("feature_index")).groupBy("sample", "feature_index", "column").agg(F.count("*").alias("barcodes")).collect()
    counted = histogram.collect()
    found = {r["sample"]: r.asDict() for r in stats.collect()}
    sizes = {r["sample"]: (r["b"], r["n"]) for r in cells.groupBy("sample").agg(F.count_distinct("plain").alias("b"), F.count("*").alias("n")).collect()}
    none = dict.fromkeys(("raw_counts", "deduped_counts", "unique_barcode_umis", "whitelisted_barcodes", "unmatched_reads", "percent_assigned"), 0)
    for s in samples:
        folder = f"{out}/{s}{inner}"
        sinks.put_text(spark, sinks.stats_text(found.get(s, none), sizes.get(s, (0, 0))[0], excluded.get(s, 0)), f"{folder}/stats.txt")
        mine = [r for r in counted if r["sample"] == s]
        sinks.put_histogram(spark, [(r["umis"], r["frequency"]) for r in mine if r["feature_index"] == 0], f"{folder}/umi_counts_histogram.html", "UMI counts")
        together = {(r["feature_index"], r["column"]): r["barcodes"] for r in richness if r["sample"] == s}
        sinks.put_heatmap(spark, together, names, {f for f, _ in together}, f"{folder}/Feature_coexpression_heatmap", "Feature Coexpression Heatmap", "coexpression")
        totals: dict[int, int] = {}
        for r in mine:
            if r["feature_index"]:
                totals[r["feature_index"]] = totals.get(r["feature_index"], 0) + r["umis"] * r["frequency"]
        chosen = {f for f, n in totals.items() if n > max(min_heatmap, 1)}
        chosen = chosen if len(chosen) >= 2 else set()
        sinks.put_heatmap(spark, {(r["feature_index"], r["umis"]): r["frequency"] for r in mine if r["feature_index"] in chosen}, names, chosen, f"{folder}/Feature_counts_heatmap", "Feature Counts (Deduplicated) Heatmap", "deduped_counts")
    columns = of_sample(qc.numbered(dedup.select("barcode").distinct(), "barcode", "rank"))
    first = columns.groupBy("sample").agg(F.min("rank").alias("first"))
    columns = cut(columns.join(F.broadcast(first), "sample").withColumn("column", F.col("rank") - F.col("first") + 1).select("barcode", "sample", "plain", "column"))
    sinks.write_by_sample(tell(columns.select("sample", F.col("plain").alias("value"), "column")), out, "barcodes.txt", folders, "column")
    entries = dedup.join(columns, "barcode").select("sample", F.concat_ws(" ", "feature_index", "column", "umis").alias("value"), "column", "feature_index")
    heads = {f"{s}{inner}": f"{sinks.MATRIX_HEAD}{len(names)} {sizes.get(s, (0, 0))[0]} {sizes.get(s, (0, 0))[1]}\n" for s in samples}
    sinks.write_by_sample(tell(entries), out, "matrix.mtx", folders, "column", "feature_index", heads=heads)  # last: a folder that holds it is whole


def kept(df: DataFrame) -> DataFrame:
    """A frame as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def demux_fastq(spark: SparkSession, probes: str, sample_map: str, out: str, directory: str | None = None, r1: str = "", r2: str = "", r3: str = "", patterns: tuple[str, str, str] = PATTERNS, offset: int = 68, probe_mate: int = 2, max_reads: int = 0) -> DataFrame:
    """samples/<sample group>/R<mate>.fastq.gz under ``out``, and stats; returns matched, unspecified, undetermined and total of each library.

    The library stands in the name of each R1 file (SC and digits); a name without one is an error.
    """
    sets = file_sets(directory, r1, r2, r3, patterns)
    if not all(s.get(f"r{probe_mate}") for s in sets):
        raise ValueError(f"every file set needs the mate with the probe, R{probe_mate}")
    names = [files.library_of(s["r1"]) for s in sets]
    if None in names:
        raise ValueError("an R1 file has no library in its name")
    sets = [s | {"sample": n, "lane": str(i)} for i, (s, n) in enumerate(zip(sets, names, strict=True))]
    records = fastq.read_any(spark, sets, strict=True, max_reads=max_reads).withColumn("read_id", F.col("lane").cast("long") * LANE_STEP + F.col("read_id"))
    reads = records.withColumn("seq", F.col(f"r{probe_mate}.seq")).withColumnRenamed("sample", "library_id")
    routed = demux.route(demux.probe_of(reads, tables.probes(spark, probes), offset), tables.sample_map(spark, sample_map))
    routed = kept(routed.select("library_id", "route", "sample_group", "read_id", "r1", "r2", "r3"))  # so that the input is read once
    sinks.write_samples(routed, f"{out}/samples")
    totals = cut(routed.groupBy("library_id").agg(*[F.count_if(F.col("route") == r).alias(r) for r in ("matched", "unspecified", "undetermined")], F.count("*").alias("total")))
    sinks.write_table(totals, f"{out}/stats", "\t")
    return totals


def demux_bam(spark: SparkSession, bam: str, probes: str, out: str, offset: int = 68, nearby: bool = False, min_mapq: int = 0, primary_only: bool = True, skip_duplicates: bool = True, gene_tag: str = "GX", count_intergenic: bool = False, count: str = "reads", cbub: str | None = None, whitelist: str | None = None, binary: bool = False, read_map: bool = False, nh_debug: bool = False, max_records: int = 0) -> DataFrame:
    """Probe counts by cell of a BAM or SAM file under ``out``; returns the counts.

    ``cbub`` takes barcodes and UMIs from a tag stream and needs ``whitelist``. ``binary`` writes the sidecar in the place of the matrix: a byte for every
    record that passes the filters of flag and quality. ``nh_debug`` writes nh_staging.jsonl (the first 1000 complete records) and nh_tap.jsonl (all counted ones).
    """
    if (cbub is None) != (whitelist is None):
        raise ValueError("a tag stream and a whitelist go together")
    if count not in ("reads", "umis"):
        raise ValueError(f"count is reads or umis, not {count}")
    sam = bam.endswith(".sam")
    raw = alignments.read_sam(spark, bam, max_records) if sam else alignments.read_bam(spark, bam, max_records, cbub=cbub)
    if cbub and sam:
        raw = demux.with_stream(raw, alignments.read_cbub(spark, cbub), max_records)
    table = cut(tables.probes(spark, probes, grouped=True))
    usable = demux.usable(raw, min_mapq, primary_only, skip_duplicates)
    records = kept(demux.described(usable, table, offset, nearby, gene_tag, count_intergenic, tables.whitelist(spark, whitelist) if cbub else None))
    counts = cut(demux.counted(records, count))
    names = table.groupBy("probe_index").agg(F.min("probe_name").alias("name"))
    if binary:
        sinks.write_sidecar(records.select("rec_no", "probe_index"), names.count(), f"{out}/probes.bin")
    else:
        sinks.write_features(names, out, index="probe_index", suffix="tsv")
        sinks.write_probe_stats(demux.record_stats(records), counts, table, f"{out}/stats.txt")
        sinks.write_matrix(counts.select(F.col("cb").alias("barcode"), F.col("probe_index").alias("feature_index"), F.col("n").alias("umis")), names.count(), out, "tsv")
    if read_map:
        sinks.write_read_map(demux.last_counted(records), f"{out}/read_to_cb_umi_gene.txt")
    if nh_debug:
        sinks.write_lines(demux.nh_staging(records), f"{out}/nh_staging.jsonl", "place")
        sinks.write_lines(demux.nh_tap(records), f"{out}/nh_tap.jsonl", "rec_no")
    return counts
