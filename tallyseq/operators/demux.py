"""Probe lookup, routing to samples, and counting over alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyseq.functions import dna
from tallyseq.operators.barcode import small

NEARBY = (0, 1, 2, -1, -2)
SECONDARY, DUPLICATE = 256 | 2048, 1024
MAPPED = 512  # variants of a probe table in one map


def probe_of(reads: DataFrame, probes: DataFrame, offset: int, k: int = 8, nearby: bool = False) -> DataFrame:
    """Adds probe_name, probe_index: the probe at ``offset`` of seq, or with ``nearby`` the first of offset, +1, +2, -1, -2 that has one; null if none.

    ``probes(variant, probe_name, probe_index)``: of equal variants the first by index counts. A table of at most MAPPED variants is one map that
    each row asks at every offset; a larger one is joined, once for each offset.
    """
    table = probes.groupBy("variant").agg(F.min(F.struct("probe_index", "probe_name")).alias("p")).select("variant", "p.*")
    shifts = NEARBY if nearby else (0,)
    held = table.where("variant is not null").limit(MAPPED + 1).collect()
    if len(held) <= MAPPED:
        kinds = dict(table.dtypes)
        entries = [x for r in held for x in (F.lit(r["variant"]), F.struct(F.lit(r["probe_index"]).cast(kinds["probe_index"]).alias("probe_index"), F.lit(r["probe_name"]).cast(kinds["probe_name"]).alias("probe_name")))]
        known = F.create_map(*entries) if entries else F.lit(None).cast(f"map<string,struct<probe_index:{kinds['probe_index']},probe_name:{kinds['probe_name']}>>")
        hit = F.coalesce(*[F.try_element_at(known, dna.kmer(F.col("seq"), offset + shift, k)) for shift in shifts])
        return reads.withColumn("hit", hit).withColumn("probe_name", F.col("hit.probe_name")).withColumn("probe_index", F.col("hit.probe_index")).drop("hit")
    out, found = reads, []
    for i, shift in enumerate(shifts):
        look = small(table).select(F.col("variant").alias(f"variant{i}"), F.struct("probe_index", "probe_name").alias(f"hit{i}"))
        out = out.withColumn(f"variant{i}", dna.kmer(F.col("seq"), offset + shift, k)).join(look, f"variant{i}", "left").drop(f"variant{i}")
        found.append(f"hit{i}")
    hit = F.coalesce(*found)
    return out.withColumn("probe_name", hit["probe_name"]).withColumn("probe_index", hit["probe_index"]).drop(*found)


def route(reads: DataFrame, sample_map: DataFrame) -> DataFrame:
    """Adds route (matched, unspecified, undetermined) and sample_group: the sample of (library_id, probe_name),
    unspecified/<library>_<probe> where the map has none, undetermined/<library>_unk where the read has no probe."""
    out = reads.join(small(sample_map.select("library_id", "probe_name", F.col("sample").alias("mapped"))), ["library_id", "probe_name"], "left")
    kind = F.when(F.col("probe_name").isNull(), "undetermined").when(F.col("mapped").isNull(), "unspecified").otherwise("matched")
    group = F.when(kind == "undetermined", F.concat(F.lit("undetermined/"), "library_id", F.lit("_unk"))).when(kind == "unspecified", F.concat(F.lit("unspecified/"), "library_id", F.lit("_"), "probe_name")).otherwise(F.col("mapped"))
    return out.withColumn("route", kind).withColumn("sample_group", group).drop("mapped")


def totals(routed: DataFrame) -> DataFrame:
    """matched, unspecified, undetermined, total."""
    return routed.agg(*[F.count_if(F.col("route") == r).alias(r) for r in ("matched", "unspecified", "undetermined")], F.count("*").alias("total"))


def library_id(path):
    """SC and digits in a file's path, null if there is none."""
    name = F.regexp_extract(path, "[^/]+$", 0)
    return F.nullif(F.regexp_extract(name, "SC[0-9]+", 0), F.lit(""))


def usable(alignments: DataFrame, min_mapq: int = 0, primary_only: bool = True, skip_duplicates: bool = True) -> DataFrame:
    """Alignments that pass the flag and mapping-quality filters; plain comparisons, so that they reach the scan."""
    out = alignments.where(F.col("mapq") >= min_mapq)
    out = out.where(F.col("flag").bitwiseAND(SECONDARY) == 0) if primary_only else out
    return out.where(F.col("flag").bitwiseAND(DUPLICATE) == 0) if skip_duplicates else out


def tagged(alignments: DataFrame, gene_tag: str = "GX", count_intergenic: bool = False) -> DataFrame:
    """Adds cb, ub, gene from the tags, drops rows without one of them, and adds countable.

    countable is false where cb or ub is '-', or the gene begins with '-' (unless ``count_intergenic``); such rows stay in the totals.
    """
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    out = alignments.withColumns({"cb": tag("CB"), "ub": tag("UB"), "gene": dna.gene_of(F.col("tags"), gene_tag), "nh": dna.hits_of(F.col("nh"))}).dropna(subset=["cb", "ub", "gene"])
    gene_ok = F.lit(True) if count_intergenic else ~F.startswith("gene", F.lit("-"))
    return out.withColumn("countable", (F.col("cb") != "-") & (F.col("ub") != "-") & gene_ok)


def with_cbub(alignments: DataFrame, cbub: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Adds cb, ub and in_range from the CBUB record at the same place in its stream (rec_no).

    A record without tags drops the row, an index beyond the whitelist keeps it, not in range. The two streams go together record by
    record: a stream that ends before the alignments do, and a number that stands in it twice, are errors.
    """
    places = cbub.groupBy("rec_no").agg(F.count("*").alias("held"), F.first(F.struct("has_tags", "cb_idx", "umi")).alias("t"))
    paired = alignments.join(places, "rec_no", "left")
    wrong = F.when(F.col("held").isNull(), F.raise_error(F.lit("the tag stream ends before the alignments do"))).when(F.col("held") > 1, F.raise_error(F.lit("a record number stands in the tag stream twice")))
    tagged_rows = paired.where(F.coalesce(wrong.cast("boolean"), F.col("t.has_tags"))).select(*alignments.columns, "t.cb_idx", F.col("t.umi").alias("ub"))
    cells = whitelist.select(F.col("wl_idx").alias("cb_idx"), F.col("barcode").alias("cb"))
    return tagged_rows.join(small(cells), "cb_idx", "left").withColumn("in_range", F.col("cb").isNotNull())


def described(alignments: DataFrame, probes: DataFrame, offset: int = 68, nearby: bool = False, gene_tag: str = "GX", count_intergenic: bool = False, whitelist: DataFrame | None = None) -> DataFrame:
    """Adds what the alignment program tells of each record: cb, ub, gene, nh, cb_place, complete, countable, probe_index, counted.

    complete: barcode, UMI and gene are there; such records are the total. probe_index: the probe of a complete record, in read orientation, else
    null. countable: neither barcode nor UMI is '-' and the gene does not begin with one (unless ``count_intergenic``). counted:
    countable and with a probe. ``whitelist``: barcode and UMI come from has_tags, cb_idx and umi of a tag stream; an index beyond the whitelist
    gives the barcode '-'; cb_place is the index where it is good, else 0.
    """
    rows = alignments.withColumns({"gene": dna.gene_of(F.col("tags"), gene_tag), "nh": dna.hits_of(F.col("nh"))})
    if whitelist is None:
        tag = lambda t: F.try_element_at("tags", F.lit(t))
        rows = rows.withColumns({"cb": tag("CB"), "ub": tag("UB"), "cb_place": F.lit(0).cast("long")})
        rows = rows.withColumn("complete", F.col("cb").isNotNull() & F.col("ub").isNotNull() & F.col("gene").isNotNull())
        good = (F.col("cb") != "-") & (F.col("ub") != "-")
    else:
        cells = small(whitelist.select(F.col("wl_idx").alias("cb_idx"), F.col("barcode").alias("listed")))
        rows = rows.join(cells, "cb_idx", "left").withColumns({"cb": F.coalesce("listed", F.lit("-")), "ub": F.col("umi"), "cb_place": F.when(F.col("listed").isNotNull(), F.col("cb_idx")).otherwise(0), "complete": F.col("has_tags") & F.col("gene").isNotNull()})
        good = F.col("listed").isNotNull()
    gene_ok = F.lit(True) if count_intergenic else ~F.startswith("gene", F.lit("-"))
    rows = rows.withColumn("countable", F.coalesce(F.col("complete") & good & gene_ok, F.lit(False)))
    rows = probe_of(rows.withColumn("seq", dna.read_orientation(F.col("seq"), F.col("flag"))), probes, offset, nearby=nearby)
    rows = rows.withColumn("probe_index", F.when(F.col("complete"), F.col("probe_index")))
    return rows.withColumn("counted", F.col("countable") & F.col("probe_index").isNotNull()).select("rec_no", "qname", "nh", "cb", "ub", "gene", "cb_place", "complete", "countable", "probe_index", "counted")


def counted(records: DataFrame, count: str = "reads") -> DataFrame:
    """cb, probe_index, n of described() records that count; ``count`` 'umis' counts distinct (ub, gene) instead of reads."""
    n = F.count("*") if count == "reads" else F.count_distinct("ub", "gene")
    return records.where("counted").groupBy("cb", "probe_index").agg(n.alias("n"))


def record_stats(records: DataFrame) -> DataFrame:
    """total_reads (complete records), countable_reads, counted of described()."""
    return records.agg(F.count_if("complete").alias("total_reads"), F.count_if("countable").alias("countable_reads"), F.count_if("counted").alias("counted"))


def last_counted(records: DataFrame) -> DataFrame:
    """qname, cb, ub, gene of the last counted record of each name."""
    return records.where("counted").groupBy("qname").agg(F.max_by(F.struct("cb", "ub", "gene"), "rec_no").alias("t")).select("qname", "t.*")


def nh_staging(records: DataFrame, most: int = 1000) -> DataFrame:
    """JSON lines (value, place) of the first ``most`` complete records, a log with a limit: event, index, qname, meta_nh, sampleIdx, cbIdxPlus1."""
    first = records.where("complete").orderBy("rec_no").limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("rec_no")) - 1)  # of ``most`` rows
    line = F.struct(F.lit("nh_staging").alias("event"), F.col("place").alias("index"), "qname", F.col("nh").alias("meta_nh"), F.coalesce("probe_index", F.lit(0)).alias("sampleIdx"), F.col("cb_place").alias("cbIdxPlus1"))
    return placed.select(F.to_json(line).alias("value"), "place")


def nh_tap(records: DataFrame) -> DataFrame:
    """JSON lines (value, rec_no) of all counted records: event, qname, nh, sampleIdx, cbIdxPlus1."""
    line = F.struct(F.lit("nh_tap").alias("event"), "qname", "nh", F.col("probe_index").alias("sampleIdx"), F.col("cb_place").alias("cbIdxPlus1"))
    return records.where("counted").select(F.to_json(line).alias("value"), "rec_no")


def with_stream(alignments: DataFrame, cbub: DataFrame, max_records: int = 0) -> DataFrame:
    """Adds has_tags, cb_idx, umi of the tag stream's record of the same number, where the two cannot be read side by side.

    A stream that ends before the alignments do, and records left over (unless ``max_records`` ends the alignments), are errors.
    """
    ends = alignments.agg(F.max("rec_no").alias("a")).first()["a"], cbub.agg(F.max("rec_no").alias("b")).first()["b"]
    have, there = ((x + 1 if x is not None else 0) for x in ends)
    if there < have:
        raise ValueError(f"the tag stream ends before the alignments do: {there} records for {have}")
    if there > have and not max_records:
        raise ValueError(f"the tag stream has {there - have} records left over")
    return alignments.join(cbub, "rec_no")


def probe_counts(alignments: DataFrame, probes: DataFrame, offset: int = 68, nearby: bool = False, count: str = "reads") -> DataFrame:
    """cb, probe_index, n over countable rows with a probe; ``count`` 'umis' counts distinct (ub, gene) instead of reads."""
    oriented = alignments.withColumn("seq", dna.read_orientation(F.col("seq"), F.col("flag")))
    hits = probe_of(oriented, probes, offset, nearby=nearby).where("countable and probe_index is not null")
    n = F.count("*") if count == "reads" else F.count_distinct("ub", "gene")
    return hits.groupBy("cb", "probe_index").agg(n.alias("n"))


def alignment_stats(alignments: DataFrame, counts: DataFrame) -> DataFrame:
    """total_reads, countable_reads, counted, cells, entries."""
    one = F.lit(1).alias("one")
    a = alignments.agg(F.count("*").alias("total_reads"), F.count_if(F.col("countable")).alias("countable_reads")).select("*", one)
    c = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"), F.count_distinct("cb").alias("cells"), F.count("*").alias("entries")).select("*", one)
    return a.join(c, "one").drop("one")


def last_per_name(alignments: DataFrame) -> DataFrame:
    """qname, cb, ub, gene of the last countable record of each name."""
    return alignments.where("countable").groupBy("qname").agg(F.max_by(F.struct("cb", "ub", "gene"), "rec_no").alias("t")).select("qname", "t.*")
