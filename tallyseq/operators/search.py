"""Feature search as an expression of one read: no join, no group and no shuffle, so it runs over streams too.

A dictionary of bounded size becomes one array of buckets. A feature has m + 1 blocks; at a distance of at most m one of them is unchanged, so a window asks
the buckets for its m + 1 blocks and leaves the row only if one is known. Distances of what is found are counted on packed codes, 31
bases in a 64-bit word, by XOR and bit count.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseq.functions import dna

MOST_FEATURES = 20_000
WORD = 31
SPLIT = 64 << 20
HIT = "array<struct<hamming:int,priority:int,position:int,window:string,feature_index:int>>"
FOUND = "array<struct<hamming:int,frame:int,feature_index:int,position:int,window:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(s: Column, length: int) -> Column:
    """Packed codes of a sequence of ``length`` bases A, C, G, T: an array of words of up to 31 bases."""
    digits = F.translate(s, "ACGT", "0123")
    return F.array(*[F.conv(F.substring(digits, at + 1, WORD), 4, 10).cast("long") for at in range(0, length, WORD)])


def distance(a: Column, b: Column) -> Column:
    """Differing bases of two arrays of packed codes."""
    return F.aggregate(F.zip_with(a, b, dna.hamming_packed), F.lit(0), lambda total, x: total + x)


def unique(hits: Column) -> Column:
    """The least hit by (hamming, priority, position, window), null if different features share the least distance or there is none."""
    other = lambda best: lambda x: (x["hamming"] == best["hamming"]) & (x["feature_index"] != best["feature_index"])
    return let(hits, lambda h: let(F.array_min(h), lambda best: F.when(~F.exists(h, other(best)), best)))


class Dictionary:
    """Features (index, sequence, anchor or None) for search at a distance of at most ``m``."""

    def __init__(self, features: list[tuple[int, str, int | None]], m: int) -> None:
        self.m, self.lengths = m, sorted({len(s) for _, s, _ in features})
        self.anchors = sorted({a for _, _, a in features if a is not None})
        entries = []
        for index, s, anchor in features:
            digits = s.translate(str.maketrans("ACGT", "0123"))
            codes = [int(digits[at : at + WORD], 4) for at in range(0, len(s), WORD)]
            for group in [""] if anchor is None else ["", f"{anchor}|"]:
                edges = self.edges(len(s))
                entries += [{"k": f"{group}{len(s)}.{b}.{s[edges[b] : edges[b + 1]]}", "f": index, "w": codes} for b in range(m + 1)]
        buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(entries)))]
        for e in entries:
            buckets[zlib.crc32(e["k"].encode()) % len(buckets)].append(e)
        self.size = len(buckets)
        # one literal, which the optimizer makes of the text once
        self.buckets = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<k:string,f:int,w:array<bigint>>>>")

    def edges(self, n: int) -> list[int]:
        return [n * i // (self.m + 1) for i in range(self.m + 2)]

    def known(self, key: Column) -> Column:
        """Entries of a key."""
        place = F.pmod(F.crc32(key.cast("binary")), F.lit(self.size)).cast("int")
        return F.filter(F.get(self.buckets, place), lambda x: x["k"] == key)

    def near(self, window: Column, n: int, group: Column) -> Column:
        """Array of struct(hamming, feature_index): the features of a group at a distance of at most m of a window of ``n`` bases; one may come twice."""
        edges = self.edges(n)
        asked = [let(F.concat(group, F.lit(f"{n}.{b}."), F.substring(window, edges[b] + 1, edges[b + 1] - edges[b])), self.known) for b in range(self.m + 1)]
        count = lambda codes: lambda x: F.struct(distance(codes, x["w"]).alias("hamming"), x["f"].alias("feature_index"))
        nothing = F.array().cast("array<struct<hamming:int,feature_index:int>>")
        found = lambda c: F.when(F.size(c) == 0, nothing).otherwise(let(words(window, n), lambda codes: F.filter(F.transform(c, count(codes)), lambda x: x["hamming"] <= self.m)))
        return let(F.flatten(F.array(*asked)), found)

    def spelled(self, raw: Column, n: int, max_n: int) -> Column:
        """A window with its N spelled out; empty if it is short, over the budget of N or holds other characters."""
        none = F.array().cast("array<string>")
        with_n = F.contains(raw, F.lit("N")) & dna.within_n_budget(raw, max_n)
        return F.when(F.length(raw) < n, none).when(dna.is_dna(raw), F.array(raw)).when(with_n, dna.expand_n(raw, max(max_n - 1, 0))).otherwise(none)

    def at(self, seq: Column, place: Column, priority: Column, max_n: int, group: Column | None = None) -> Column:
        """Hits at a place (see HIT): of each spelled window the single closest feature."""
        group = F.lit("") if group is None else group

        def hit(n: int) -> Callable[[Column], Column]:
            return lambda w: let(unique_feature(self.near(w, n, group)), lambda c: F.struct(c["hamming"].alias("hamming"), priority.alias("priority"), place.cast("int").alias("position"), w.alias("window"), c["feature_index"].alias("feature_index")))

        found = [F.transform(let(F.substring(seq, (place + 1).cast("int"), F.lit(n)), lambda raw, n=n: self.spelled(raw, n, max_n)), hit(n)) for n in self.lengths]
        every = F.flatten(F.array(*found)) if found else F.array()
        return F.when(place >= 0, F.filter(every.cast(HIT), lambda x: x["hamming"].isNotNull())).otherwise(F.array().cast(HIT))

    def anchored(self, seq: Column, anchor: Column | None, shift: int, max_n: int) -> Column:
        """Hits at an anchor and a shift; without ``anchor`` each feature at its own."""
        zero = F.lit(0)
        if anchor is not None:
            return self.at(seq, anchor + shift, zero, max_n)
        if not self.anchors:
            return F.array().cast(HIT)
        each = lambda o: self.at(seq, o + shift, zero, max_n, F.concat(o.cast("string"), F.lit("|")))
        return F.flatten(F.transform(F.array(*map(F.lit, self.anchors)), each))

    def exact(self, seq: Column, anchor: Column) -> Column:
        """The feature equal to the read at the anchor; of several lengths, the smallest index."""
        hits = F.filter(self.at(seq, anchor, F.lit(0), 0), lambda x: x["hamming"] == 0)
        least = F.array_min(F.transform(hits, lambda x: F.struct(x["feature_index"].alias("feature_index"), x["position"].alias("position"), x["window"].alias("window"))))
        return let(least, lambda x: F.when(x.isNotNull(), F.struct(F.lit(0).alias("hamming"), x["feature_index"].alias("feature_index"), x["position"].alias("position"), x["window"].alias("window"))))

    def fuzzy(self, seq: Column, anchor: Column | None, max_n: int) -> Column:
        return outcome(unique(self.anchored(seq, anchor, 0, max_n)))

    def in_window(self, seq: Column, anchor: int, reach: int, max_n: int) -> Column:
        """At the anchor, +1, -1, +2, -2 ... up to ``reach``: the first exact hit, else the single closest feature, at its first place."""
        shifts = [0] + [s for k in range(1, reach + 1) for s in (k, -k)]
        places = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(anchor + s).alias("place")) for i, s in enumerate(shifts) if anchor + s >= 0])
        hits = F.flatten(F.transform(places, lambda p: self.at(seq, p["place"], p["priority"], max_n)))
        first = lambda h: F.array_min(F.transform(F.filter(h, lambda x: x["hamming"] == 0), lambda x: F.struct(x["priority"].alias("priority"), x["feature_index"].alias("feature_index"), x["position"].alias("position"), x["window"].alias("window"), x["hamming"].alias("hamming"))))
        return let(hits, lambda h: F.coalesce(outcome(first(h)), outcome(unique(h))))

    def everywhere(self, seq: Column, max_n: int) -> Column:
        """struct(hamming, feature_index, position, window) at the least distance at any place, null if there is none within m.

        The first exact hit by (position mod 4, feature, position) counts; other distances must be reached once, else feature_index is null.
        """

        def windows(text: Column, n: int) -> Column:
            hit = lambda i: let(F.substring(text, (i + 1).cast("int"), F.lit(n)), lambda w: F.transform(self.near(w, n, F.lit("")), lambda c: F.struct(c["hamming"].alias("hamming"), (i % 4).cast("int").alias("frame"), c["feature_index"].alias("feature_index"), i.cast("int").alias("position"), w.alias("window"))))
            return F.when(F.length(text) >= n, F.flatten(F.transform(F.sequence(F.lit(0), F.length(text) - n), hit))).otherwise(F.array().cast(FOUND))

        def settled(h: Column) -> Column:
            single = lambda best: (best["hamming"] == 0) | (F.size(F.filter(h, lambda x: x["hamming"] == best["hamming"])) == 1)
            answer = lambda best: F.when(best.isNotNull(), F.struct(best["hamming"].alias("hamming"), F.when(single(best), best["feature_index"]).alias("feature_index"), best["position"].alias("position"), best["window"].alias("window")))
            return let(F.array_min(h), answer)

        if not self.lengths:
            return F.lit(None).cast("struct<hamming:int,feature_index:int,position:int,window:string>")
        each = lambda text: F.flatten(F.array(*[windows(text, n) for n in self.lengths]))
        hits = F.flatten(F.transform(dna.expand_n(seq, max(max_n - 1, 0)), each))
        return F.when(dna.within_n_budget(seq, max_n), let(F.array_distinct(hits), settled))

    def cascade(self, seq: Column, anchor: Column | None, max_n: int) -> Column:
        """At the anchor (or each feature's own); exact one base before it, then behind it; then everywhere, which only beats an anchored hit if it is closer.

        With a distance over 1 to the anchored feature, a closer one a base beside takes its place. Where what is closer everywhere is not single, nothing is found.
        """
        at, before, behind = (unique(self.anchored(seq, anchor, shift, max_n)) for shift in (0, -1, 1))
        closer = lambda a, b: F.when(a.isNotNull() & b.isNotNull() & (b["hamming"] < a["hamming"]), b).otherwise(a)

        def beside(a: Column) -> Column:
            return F.when(a["hamming"] == 0, outcome(a)).otherwise(let(before, lambda b: F.when(b["hamming"] == 0, outcome(b)).otherwise(let(behind, lambda c: F.when(c["hamming"] == 0, outcome(c)).otherwise(wider(closer(closer(a, b), c)))))))

        def wider(a: Column) -> Column:
            return let(a, lambda best: let(self.everywhere(seq, max_n), lambda w: F.when(best.isNull() | (w["hamming"] < best["hamming"]), w).otherwise(outcome(best))))

        return let(at, beside)


def unique_feature(hits: Column) -> Column:
    """struct(hamming, feature_index) at the least distance, null if several features share it."""
    return unique(hits)


def outcome(hit: Column) -> Column:
    """struct(hamming, feature_index, position, window) of a hit, null for none."""
    return let(hit, lambda x: F.when(x.isNotNull(), F.struct(x["hamming"].alias("hamming"), x["feature_index"].alias("feature_index"), x["position"].alias("position"), x["window"].alias("window"))))


def dictionary(features: DataFrame, m: int, anchors: bool = False) -> Dictionary | None:
    """Dictionary of features(feature_index, sequence, pattern_offset with ``anchors``); None if there are over MOST_FEATURES."""
    anchor = F.when(F.col("pattern_offset") >= 0, F.col("pattern_offset").cast("int")) if anchors else F.lit(None).cast("int")
    rows = features.select(F.col("feature_index").cast("int"), "sequence", anchor).limit(MOST_FEATURES + 1).collect()
    return Dictionary([tuple(r) for r in rows], m) if len(rows) <= MOST_FEATURES else None


def spread(reads: DataFrame) -> DataFrame:
    """An input of less than a split for each core is dealt over the cores, as a search costs far more than a row's way there; larger ones, and streams, stay where they are."""
    if reads.isStreaming:
        return reads
    cores = reads.sparkSession.sparkContext.defaultParallelism
    leaves = reads._jdf.queryExecution().optimizedPlan().collectLeaves()  # what is read; estimates above joins are products
    held = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return reads.repartition(cores) if held < cores * SPLIT else reads


def found(reads: DataFrame, hit: Column, kind: str = "int") -> DataFrame:
    """``reads`` with a hit: all their columns, feature_index (of type ``kind``), hamming, match_position and matched_sequence.

    A generator keeps the rows, so that the search is not done once for a filter and again for its columns.
    """
    kept = F.inline(F.filter(F.array(hit), lambda x: x["feature_index"].isNotNull())).alias("hamming", "feature_index", "match_position", "matched_sequence")
    out = spread(reads).select(*reads.columns, kept)
    return out.withColumn("feature_index", F.col("feature_index").cast(kind))
