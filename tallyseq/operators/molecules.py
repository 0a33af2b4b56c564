"""Molecules: counts, UMI cliques and the votes that deduplicate them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.functions import dna
from tallyseq.operators.common import cut


def raw_counts(assigned: DataFrame) -> DataFrame:
    """Reads per (barcode, feature_index): n."""
    return assigned.groupBy("barcode", "feature_index").agg(F.count("*").alias("n"))


def barcode_totals(assigned: DataFrame) -> DataFrame:
    """raw_counts() with a total for each barcode and one for all (feature_index, then barcode null)."""
    return assigned.rollup("barcode", "feature_index").agg(F.count("*").alias("n"))


def molecule_counts(assigned: DataFrame) -> DataFrame:
    """Reads per (barcode, umi, feature_index)."""
    return assigned.groupBy("barcode", "umi", "feature_index").agg(F.count("*").alias("reads"))


def umi_edges(molecules: DataFrame, umi_length: int, strict: bool = False) -> DataFrame:
    """(barcode, umi, other): pairs of UMIs of a barcode at distance one, both ways.

    ``strict`` leaves out changes at every fourth position (0, 4, 8 ...), which the classic neighbour table never makes.
    """
    umis = molecules.select("barcode", "umi").distinct()
    near = umis.select("barcode", "umi", F.explode(dna.neighbours(F.col("umi"), umi_length)).alias("x"))
    near = near.where("x.pos % 4 <> 0") if strict else near
    return near.select("barcode", "umi", F.col("x.sequence").alias("other")).join(umis.withColumnRenamed("umi", "other"), ["barcode", "other"], "left_semi").select("barcode", "umi", "other")


def cliques(molecules: DataFrame, umi_length: int, strict: bool = False, pandas_limit: int = 200_000) -> DataFrame:
    """(barcode, clique_id, feature_index, reads): connected UMIs of a barcode taken together; clique_id is the smallest UMI.

    Molecules are dealt once by barcode and joined there, some thousand rows at a time. A barcode of more than ``pandas_limit`` molecules is
    labelled by repeated minimum joins over its neighbour pairs, so no unbounded group meets in one task. Rows without a barcode or UMI are
    cliques of their own.
    """
    known = F.col("barcode").isNotNull() & F.col("umi").isNotNull()
    large = cut(molecules.where(known).groupBy("barcode").agg(F.count("*").alias("held")).where(F.col("held") > pandas_limit).select("barcode"))
    rest = molecules.where(known).select("barcode", "umi", "feature_index", "reads")
    lone = molecules.where(~known).withColumn("clique_id", F.col("umi"))
    if large.take(1):
        most = molecules.where(known).join(large, "barcode", "left_semi")
        edges = umi_edges(most, umi_length, strict)  # one way only where a UMI holds other characters
        labels = _spread(edges.unionByName(edges.select("barcode", F.col("other").alias("umi"), F.col("umi").alias("other"))).distinct())
        rest = rest.join(large, "barcode", "left_anti")
        lone = lone.unionByName(most.join(labels, ["barcode", "umi"], "left").withColumn("clique_id", F.coalesce("clique_id", "umi")).select(*lone.columns))
    schema = f"barcode string, clique_id string, feature_index {molecules.schema['feature_index'].dataType.simpleString()}, reads long"
    joined = rest.repartition("barcode").sortWithinPartitions("barcode").mapInArrow(grouped(umi_length, strict), schema)
    return joined.unionByName(lone.groupBy("barcode", "clique_id", "feature_index").agg(F.sum("reads").alias("reads")))


def grouped(umi_length: int, strict: bool) -> Callable:
    """mapInArrow function: molecules by barcode to (barcode, clique_id, feature_index, reads)."""
    places = [p for p in range(umi_length) if not strict or p % 4]

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        barcode = rows.column("barcode").combine_chunks().dictionary_encode()
        umi = np.array(rows.column("umi").cast(pa.binary()).to_pylist())
        of = barcode.indices.to_numpy()
        order = np.lexsort((umi, of))
        new = np.append(True, (of[order][1:] != of[order][:-1]) | (umi[order][1:] != umi[order][:-1]))
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        names = umi[order][new]
        label = names[components(of[order][new], names, umi_length, places)]
        found = rows.set_column(rows.schema.get_field_index("umi"), "clique_id", pa.array(label[node].tolist(), pa.binary()).cast(pa.string()))
        out = found.group_by(["barcode", "clique_id", "feature_index"]).aggregate([("reads", "sum")]).rename_columns({"reads_sum": "reads"})
        yield from out.select(["barcode", "clique_id", "feature_index", "reads"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = pc.index(b.column("barcode"), b.column("barcode")[-1]).as_py()  # the last barcode may go on in the next batch
            if last or (held and held[-1].column("barcode")[-1] != b.column("barcode")[0]):
                yield from joined(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from joined(pa.Table.from_batches(held))

    return run


def components(of: np.ndarray, umis: np.ndarray, length: int, places: list[int]) -> np.ndarray:
    """For distinct (barcode number, UMI) in order, the number of the smallest that each is connected with.

    UMIs of ``length`` bases that agree but for one place share a key without that place; others are linked through their neighbours, made as dna.neighbours() makes them.
    """
    width = max(umis.dtype.itemsize, length)
    text = np.frombuffer(umis.astype(f"S{width}").tobytes(), np.uint8).reshape(len(umis), width)
    base = np.full(256, 4, np.int64)
    base[list(b"ACGT")] = range(4)
    codes = base[text[:, :length]]
    plain = (codes < 4).all(1) & (text[:, length:] == 0).all(1) & (length <= 16)
    which = np.flatnonzero(plain)
    shifts = 2 * np.arange(length - 1, -1, -1) if length <= 16 else np.zeros(length, np.int64)
    key = (of[which].astype(np.int64) << min(2 * length, 32)) | (codes[which] << shifts).sum(1)
    groups = []
    for p in places if len(which) else ():
        masked = key & ~np.int64(3 << int(shifts[p]))
        order = np.argsort(masked, kind="stable")
        starts = np.flatnonzero(np.append(True, masked[order][1:] != masked[order][:-1]))
        groups.append((which[order], starts, np.diff(np.append(starts, len(order)))))
    pairs = odd_pairs(of, umis, np.flatnonzero(~plain), length, places)
    label = np.arange(len(umis))
    while True:
        before = label.copy()
        for members, starts, sizes in groups:
            label[members] = np.repeat(np.minimum.reduceat(label[members], starts), sizes)
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
        label = label[label]
        if (label == before).all():
            return label


def odd_pairs(of: np.ndarray, umis: np.ndarray, odd: np.ndarray, length: int, places: list[int]) -> list[tuple[int, int]]:
    """Pairs of UMIs, the first with other characters or another length, whose neighbour the second is."""
    if not len(odd):
        return []
    there = {(b, u.decode()): i for i, (b, u) in enumerate(zip(of.tolist(), umis.tolist(), strict=True))}
    out = []
    for x in odd.tolist():
        u = umis[x].decode()
        for p in places:
            at = max(dna.BASES.find(u[p : p + 1]), 0)
            near = [u[:p] + s[at] + u[p + 1 : p + 1 + length] for s in ("CGTA", "GTAC", "TACG")]
            out += [(x, there[of[x], n]) for n in near if (of[x], n) in there]
    return out


def _spread(edges: DataFrame) -> DataFrame:
    """Smallest reachable UMI by repeated minimum over neighbours; a checkpoint each round cuts the lineage."""
    edges = cut(edges)
    labels = cut(edges.groupBy("barcode", "umi").agg(F.least(F.min("other"), F.col("umi")).alias("clique_id")))
    while True:
        near = edges.join(labels.select("barcode", F.col("umi").alias("other"), F.col("clique_id").alias("near")), ["barcode", "other"]).groupBy("barcode", "umi").agg(F.min("near").alias("near"))
        jump = labels.select("barcode", F.col("umi").alias("clique_id"), F.col("clique_id").alias("far"))
        best = cut(labels.join(near, ["barcode", "umi"]).join(jump, ["barcode", "clique_id"]).select("barcode", "umi", F.least("clique_id", "near", "far").alias("clique_id"), (F.least("near", "far") < F.col("clique_id")).alias("moved")))
        labels = best.drop("moved")
        if not best.where("moved").take(1):
            return labels


def clique_votes(clique_reads: DataFrame, stringency: int = 1, min_counts: int = 1, strict: bool = False) -> DataFrame:
    """(barcode, feature_index, umis): one vote of each clique.

    stringency 0: every feature with reads > min_counts. 1 ... 999: the single feature with most reads, if these
    are over total * stringency / 1000 and the total is over min_counts. 1000 and more: the only feature, if its reads
    are over min_counts; ``strict`` takes the lowest feature index of several instead.
    """
    if stringency == 0:
        votes = clique_reads.where(F.col("reads") > min_counts).select("barcode", "feature_index")
    else:
        top = F.max(F.struct("reads", (-F.col("feature_index")).alias("k")))
        per = clique_reads.groupBy("barcode", "clique_id").agg(
            F.sum("reads").alias("total"), F.max("reads").alias("top"), F.count("*").alias("features"), top.alias("best"), F.max(F.struct("reads", "feature_index")).alias("last"), F.min(F.struct("feature_index", "reads")).alias("lowest"),
        )
        if stringency < 1000:
            unique = F.col("last.feature_index") == -F.col("best.k")
            per = per.where(unique & (F.col("top") > F.col("total") * stringency / 1000) & (F.col("total") > min_counts))
            votes = per.select("barcode", F.col("last.feature_index").alias("feature_index"))
        else:
            per = per if strict else per.where("features = 1")
            votes = per.where(F.col("lowest.reads") > min_counts).select("barcode", "lowest.feature_index")
    return votes.groupBy("barcode", "feature_index").agg(F.count("*").alias("umis"))


def dedup_counts(molecules: DataFrame, umi_length: int, stringency: int = 1, min_counts: int = 1, strict: bool = False) -> DataFrame:
    """Molecules to (barcode, feature_index, umis)."""
    return clique_votes(cliques(molecules, umi_length, strict), stringency, min_counts, strict)


def distinct_counts(molecules: DataFrame) -> DataFrame:
    """Distinct (barcode, umi) pairs and barcodes: barcode_umis, barcodes."""
    return molecules.agg(F.count_distinct("barcode", "umi").alias("barcode_umis"), F.count_distinct("barcode").alias("barcodes"))

