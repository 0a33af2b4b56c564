"""The three programs as plans over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.functions import dna
from tallyseq.operators import barcode, demux, match, molecules, qc
from tallyseq.operators.common import cut


def classed(reads: DataFrame, whitelist: DataFrame, features: DataFrame, barcode_length: int, offset: int | None = None, m: int = 1, max_n_feature: int = 3, max_n_barcode: int = 1, max_candidates: int = 3, min_posterior: float = 0.975, reach: int = -1, anchored_only: bool = False, translate_nxt: bool = False, hits: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Reads with feature_index (null: unmatched) and, for the matched, status and corrected barcode.

    Features are searched first, unless ``hits(read_id, feature_index)`` are at hand; only matched reads go on to barcode correction.
    """
    matched = settled(reads, whitelist, features, barcode_length, offset, m, max_n_feature, max_n_barcode, max_candidates, min_posterior, reach, anchored_only, translate_nxt, hits, by)
    return reads.select("read_id", "umi", *by).join(matched.drop("umi", *by), "read_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))


def settled(reads: DataFrame, whitelist: DataFrame, features: DataFrame, barcode_length: int, offset: int | None = None, m: int = 1, max_n_feature: int = 3, max_n_barcode: int = 1, max_candidates: int = 3, min_posterior: float = 0.975, reach: int = -1, anchored_only: bool = False, translate_nxt: bool = False, hits: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(read_id, umi, feature_index, status, corrected) of the reads with a feature; with ``by``, columns within which barcodes are rescued, these too."""
    if hits is not None:
        hits = reads.join(hits.select("read_id", "feature_index"), "read_id")
    elif anchored_only:
        hits = match.annotated(reads, features, offset, m, max_n_feature)
    else:
        hits = reads.join(match.cascade(reads, features, offset, m, max_n_feature, reach).select("read_id", "feature_index"), "read_id")
    hits = cut(hits.select("read_id", "barcode", "umi", "barcode_qual", "feature_index", *by))  # met four times from here on
    matched = barcode.correct(hits, whitelist, barcode_length, max_candidates, max_n_barcode, min_posterior, by)
    corrected = dna.translate_nxt(F.col("corrected")) if translate_nxt else F.col("corrected")
    return matched.select("read_id", "umi", "feature_index", "status", corrected.alias("corrected"), *by)


def assigned(reads: DataFrame, whitelist: DataFrame, features: DataFrame, barcode_length: int, **options) -> DataFrame:
    """(read_id, barcode, umi, feature_index) of the reads with a feature and a barcode."""
    done = settled(reads, whitelist, features, barcode_length, **options).where("corrected is not null")
    return done.select("read_id", F.col("corrected").alias("barcode"), "umi", "feature_index")


def assign_barcodes(reads: DataFrame, whitelist: DataFrame, features: DataFrame, barcode_length: int = 16, umi_length: int = 12, stringency: int = 1, min_counts: int = 1, strict: bool = False, allowed: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """raw, molecules, dedup, per_cell, stats (and filtered, excluded with ``allowed``) of reads(read_id, barcode, umi, barcode_qual, seq)."""
    rows = classed(reads, whitelist, features, barcode_length, **options)
    given = rows.where("corrected is not null").select("read_id", F.col("corrected").alias("barcode"), "umi", "feature_index")
    raw, mol = molecules.raw_counts(given), molecules.molecule_counts(given)
    dedup = molecules.dedup_counts(mol, umi_length, stringency, min_counts, strict)
    out = {"raw": raw, "molecules": mol, "dedup": dedup, "per_cell": qc.feature_per_cell(dedup), "stats": qc.run_stats(rows, raw, dedup, mol)}
    if allowed is not None:
        out |= {"filtered": qc.semi(dedup, allowed), "excluded": qc.excluded(dedup, allowed)}
    return out


def demux_fastq(records: DataFrame, probes: DataFrame, sample_map: DataFrame, library_id: str, offset: int = 68, probe_mate: int = 2) -> DataFrame:
    """FASTQ records with route and sample_group; no shuffle, the dictionaries are broadcast."""
    reads = records.withColumn("seq", F.col(f"r{probe_mate}.seq")).withColumn("library_id", F.lit(library_id))
    return demux.route(demux.probe_of(reads, probes, offset), sample_map)


def demux_bam(alignments: DataFrame, probes: DataFrame, offset: int = 68, min_mapq: int = 0, primary_only: bool = True, skip_duplicates: bool = True, nearby: bool = False, gene_tag: str = "GX", count_intergenic: bool = False, count: str = "reads") -> dict[str, DataFrame]:
    """counts and stats of alignments."""
    rows = demux.tagged(demux.usable(alignments, min_mapq, primary_only, skip_duplicates), gene_tag, count_intergenic)
    counts = demux.probe_counts(rows, probes, offset, nearby, count)
    return {"counts": counts, "stats": demux.alignment_stats(rows, counts), "last": demux.last_per_name(rows)}
