"""Feature search: exact, fuzzy at an anchor, in a window, exhaustive, and their cascade.

Features are a dictionary (features(feature_index, name, sequence)). Where its size allows, which is checked, a search is an expression
of each read (see search.py). Beyond that it is a join of distinct windows with the features' blocks, joined back by text;
both give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseq.functions import dna
from tallyseq.operators import search
from tallyseq.operators.barcode import small
from tallyseq.operators.common import cut

HIT = ["read_id", "feature_index", "hamming", "match_position", "matched_sequence"]


def lengths_of(features: DataFrame) -> list[int]:
    """Distinct feature lengths: a property of the dictionary, not of the reads."""
    return sorted(r[0] for r in features.select(F.length("sequence")).distinct().collect())


def place(offset: Column | int) -> Column:
    return F.lit(offset) if isinstance(offset, int) else offset


def kind_of(features: DataFrame) -> str:
    return dict(features.dtypes)["feature_index"]


def exact_at(reads: DataFrame, features: DataFrame, offset: Column | int) -> DataFrame:
    """Features equal to the read at ``offset`` (0-based); of several lengths, the smallest feature index."""
    offset = place(offset)
    if known := search.dictionary(features, 0):
        return search.found(reads.select("read_id", "seq"), known.exact(F.col("seq"), offset), kind_of(features)).select(*HIT)
    found = []
    for n in lengths_of(features):
        window = F.substring(F.col("seq"), offset + 1, F.lit(n))
        sized = features.where(F.length("sequence") == n).select("feature_index", F.col("sequence").alias("matched_sequence"))
        found.append(reads.select("read_id", offset.alias("match_position"), window.alias("matched_sequence")).join(small(sized), "matched_sequence"))
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("read_id").agg(F.min(F.struct("feature_index", "match_position", "matched_sequence")).alias("m"))
    return best.select("read_id", "m.feature_index", F.lit(0).alias("hamming"), "m.match_position", "m.matched_sequence")


def within(windows: DataFrame, features: DataFrame, m: int) -> DataFrame:
    """(window, feature_index, hamming) of every feature at distance <= m of the distinct ``windows(window)``.

    Pigeonhole: of m + 1 blocks of a feature one is unchanged in a window at distance <= m, so an equality
    join on (length, block, its text) finds every candidate; distances are then counted.
    """
    parts = []
    for n in lengths_of(features):
        edges = [n * i // (m + 1) for i in range(m + 2)]
        block = lambda s, edges=edges: F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.substring(s, edges[i] + 1, edges[i + 1] - edges[i]).alias("seed")) for i in range(m + 1)]))
        f = features.where(F.length("sequence") == n).select("feature_index", "sequence", block(F.col("sequence")).alias("b")).select("feature_index", "sequence", "b.*")
        w = windows.where(F.length("window") == n).select("window", block(F.col("window")).alias("b")).select("window", "b.*")
        parts.append(w.join(small(f), ["block", "seed"]).select("window", "feature_index", "sequence"))
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    return pairs.select("window", "feature_index", dna.hamming(F.col("window"), F.col("sequence")).alias("hamming")).where(F.col("hamming") <= m)


def closest(windows: DataFrame, features: DataFrame, m: int) -> DataFrame:
    """(window, feature_index, hamming) of the windows with one single feature at the least distance <= m."""
    near = within(windows, features, m)
    best = near.groupBy("window").agg(F.min(F.struct("hamming", "feature_index")).alias("first"), F.min(F.struct("hamming", (-F.col("feature_index")).alias("k"))).alias("last"))
    return best.where("first.feature_index = -last.k").select("window", "first.feature_index", "first.hamming")


def spelled(reads: DataFrame, offset: Column, lengths: list[int], max_n: int) -> DataFrame:
    """(read_id, position, raw, window): windows at ``offset``, with their N spelled out; N budget as in dna.within_n_budget."""
    cuts = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(F.col("seq"), offset + 1, F.lit(n)).alias("raw")) for n in lengths]))
    rows = reads.select("read_id", offset.alias("position"), cuts.alias("c")).select("read_id", "position", "c.raw", "c.n").where(F.length("raw") == F.col("n"))
    clean = rows.where(dna.is_dna(F.col("raw"))).withColumn("window", F.col("raw"))
    with_n = rows.where(F.col("raw").contains("N") & dna.within_n_budget(F.col("raw"), max_n)).withColumn("window", F.explode(dna.expand_n(F.col("raw"), max(max_n - 1, 0))))
    return clean.unionByName(with_n).select("read_id", "position", "raw", "window")


def _unique_best(hits: DataFrame) -> DataFrame:
    """Per read the hit at the least distance; none if different features tie there. Of equal hits, the first by priority."""
    low = hits.groupBy("read_id").agg(F.min("hamming").alias("low"))
    best = hits.join(low, "read_id").where("hamming = low")
    one = best.groupBy("read_id").agg(F.min("feature_index").alias("a"), F.max("feature_index").alias("b"), F.min(F.struct("priority", "position", "window", "hamming")).alias("m"))
    return one.where("a = b").select("read_id", F.col("a").alias("feature_index"), "m.hamming", F.col("m.position").alias("match_position"), F.col("m.window").alias("matched_sequence"))


def annotated(reads: DataFrame, features: DataFrame, offset: Column | int, m: int = 1, max_n: int = 3) -> DataFrame:
    """The reads that fuzzy_at() matches, with all their columns and those of the hit.

    With a dictionary too large for an expression, only the distinct texts at the anchor are searched, and reads meet the answers by that text.
    """
    offset = place(offset)
    if known := search.dictionary(features, m):
        return search.found(reads, known.fuzzy(F.col("seq"), offset, max_n), kind_of(features))
    return annotated_by_join(reads, features, offset, m, max_n)


def annotated_by_join(reads: DataFrame, features: DataFrame, offset: Column, m: int, max_n: int) -> DataFrame:
    lengths = lengths_of(features)
    keyed = reads.withColumn("anchor_text", F.substring(F.col("seq"), offset + 1, F.lit(max(lengths, default=0))))
    texts = keyed.select(F.col("anchor_text").alias("read_id"), F.col("anchor_text").alias("seq")).distinct()
    rows = spelled(texts, F.lit(0), lengths, max_n)
    found = closest(rows.select("window").distinct(), features, m)
    best = _unique_best(rows.join(found, "window").withColumn("priority", F.lit(0)))
    best = best.select(F.col("read_id").alias("anchor_text"), "feature_index", "hamming", "matched_sequence")
    return keyed.join(best, "anchor_text").withColumn("match_position", offset).drop("anchor_text")


def fuzzy_at(reads: DataFrame, features: DataFrame, offset: Column | int, m: int = 1, max_n: int = 3) -> DataFrame:
    """Single closest feature at distance <= m of the read at ``offset``; N are spelled out, ties between features reject."""
    return annotated(reads, features, offset, m, max_n).select(*HIT)


def in_window(reads: DataFrame, features: DataFrame, offset: int, reach: int, m: int = 1, max_n: int = 3) -> DataFrame:
    """fuzzy_at() at offset, +1, -1, +2, -2 ... up to ``reach``; exact hits win, ties of one feature take the first offset, ties of different ones reject."""
    if known := search.dictionary(features, m):
        return search.found(reads.select("read_id", "seq"), known.in_window(F.col("seq"), offset, reach, max_n), kind_of(features)).select(*HIT)
    shifts = [0] + [s for k in range(1, reach + 1) for s in (k, -k)]
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(offset + s).alias("place")) for i, s in enumerate(shifts) if offset + s >= 0]))
    lengths = lengths_of(features)
    at = reads.select("read_id", "seq", places.alias("p")).select("read_id", "seq", "p.*")
    rows = spelled(at.select(F.struct("read_id", "priority").alias("read_id"), "seq", "place"), F.col("place"), lengths, max_n)
    rows = rows.select(F.col("read_id.read_id").alias("read_id"), F.col("read_id.priority").alias("priority"), "position", "window")
    found = closest(rows.select("window").distinct(), features, m)
    hits = rows.join(found, "window")
    exact = hits.where("hamming = 0").groupBy("read_id").agg(F.min_by(F.struct("feature_index", "hamming", F.col("position").alias("match_position"), F.col("window").alias("matched_sequence")), F.struct("priority", "feature_index")).alias("m")).select("read_id", "m.*")
    return exact.unionByName(_unique_best(hits.join(exact.select("read_id"), "read_id", "left_anti")))


def exhaustive(reads: DataFrame, features: DataFrame, m: int = 1, max_n: int = 3) -> DataFrame:
    """Single closest feature at any offset. The first exact hit by (position mod 4, feature, position) wins; otherwise the least distance must be reached once.

    With a dictionary too large for an expression, distinct read sequences are searched, through seeds (see closest()), and joined back.
    """
    if known := search.dictionary(features, m):
        return search.found(reads.select("read_id", "seq"), known.everywhere(F.col("seq"), max_n), kind_of(features)).select(*HIT)
    return exhaustive_by_join(reads, features, m, max_n)


def exhaustive_by_join(reads: DataFrame, features: DataFrame, m: int, max_n: int) -> DataFrame:
    return everywhere_by_join(reads, features, m, max_n).where("feature_index is not null")


def everywhere_by_join(reads: DataFrame, features: DataFrame, m: int, max_n: int) -> DataFrame:
    """The least distance of each read that has one, with feature_index null where a distance over 0 is reached more than once."""
    texts = reads.select("seq").distinct()
    rows = texts.where(dna.within_n_budget(F.col("seq"), max_n)).select("seq", F.explode(dna.expand_n(F.col("seq"), max(max_n - 1, 0))).alias("whole"))
    cuts = [rows.select("seq", F.explode(dna.windows(F.col("whole"), n)).alias("w")).select("seq", "w.*") for n in lengths_of(features)]
    windows = reduce(DataFrame.unionByName, cuts).distinct()
    hits = windows.join(within(windows.select("window").distinct(), features, m), "window")
    exact = hits.where("hamming = 0").groupBy("seq").agg(F.min(F.struct(F.col("position") % 4, "feature_index", "position", "window")).alias("m")).select("seq", "m.feature_index", F.lit(0).alias("hamming"), F.col("m.position").alias("match_position"), F.col("m.window").alias("matched_sequence"))
    rest = hits.join(exact.select("seq"), "seq", "left_anti").withColumnRenamed("seq", "read_id").withColumn("priority", F.lit(0))
    least = rest.groupBy("read_id").agg(F.min_by(F.struct("hamming", "feature_index", F.col("position").alias("match_position"), F.col("window").alias("matched_sequence")), F.struct("hamming", "feature_index", "position", "window")).alias("m"), F.min("hamming").alias("low"))
    times = rest.join(least.select("read_id", "low"), "read_id").where("hamming = low").groupBy("read_id").agg(F.count("*").alias("times"))
    fuzzy = least.join(times, "read_id").select(F.col("read_id").alias("seq"), F.when(F.col("times") == 1, F.col("m.feature_index")).alias("feature_index"), "m.hamming", "m.match_position", "m.matched_sequence")
    return reads.select("read_id", "seq").join(exact.unionByName(fuzzy.select(*exact.columns)), "seq").select(*HIT)


def found_in(reads: DataFrame, features: DataFrame, offset: int | str | None = None, m: int = 1, max_n: int = 3, reach: int = -1) -> DataFrame:
    """The reads that cascade() matches, with all their columns, for dictionaries of up to search.MOST_FEATURES and for streams too; no joins."""
    known = search.dictionary(features, m, offset == OWN)
    if known is None:
        raise ValueError(f"over {search.MOST_FEATURES} features: use cascade()")
    seq = F.col("seq")
    if offset is None:
        hit = known.everywhere(seq, max_n)
    elif reach >= 0 and offset != OWN:
        hit = known.in_window(seq, offset, reach, max_n)
    else:
        hit = known.cascade(seq, None if offset == OWN else F.lit(offset), max_n)
    return search.found(reads, hit, kind_of(features))


OWN = "each feature's own"


def cascade(reads: DataFrame, features: DataFrame, offset: int | str | None = None, m: int = 1, max_n: int = 3, reach: int = -1) -> DataFrame:
    """Search driver: at the anchor; exact one base before it, then behind it; then everywhere (see search.Dictionary.cascade()).

    ``offset`` OWN: each feature at the pattern_offset it has; those without one are found everywhere only. With ``reach`` >= 0 the anchor search is
    in_window() and nothing else. Without an offset the search is exhaustive.
    """
    reads = reads.select("read_id", "seq")
    if search.dictionary(features, m):
        return found_in(reads, features, offset, m, max_n, reach).select(*HIT)
    if offset is None:
        return exhaustive_by_join(reads, features, m, max_n)
    if reach >= 0 and offset != OWN:
        return in_window(reads, features, offset, reach, m, max_n)
    groups = [(offset, features)] if offset != OWN else [(r[0], features.where(F.col("pattern_offset") == r[0])) for r in features.where("pattern_offset >= 0").select("pattern_offset").distinct().collect()]

    def beside(shift: int) -> DataFrame:
        """Single closest features at the anchors and a shift."""
        found = [annotated_by_join(reads, f, F.lit(o + shift), m, max_n).select(*HIT) for o, f in groups if o + shift >= 0]
        hits = reduce(DataFrame.unionByName, found, reads.sparkSession.createDataFrame([], found[0].schema) if found else exhaustive_by_join(reads.limit(0), features, m, max_n))
        return _unique_best(hits.withColumnsRenamed({"match_position": "position", "matched_sequence": "window"}).withColumn("priority", F.lit(0)))

    at, before, behind = (cut(beside(s).withColumn("rank", F.lit(i))) for i, s in enumerate((0, -1, 1)))
    exact = at.unionByName(before).unionByName(behind).where("hamming = 0")
    first = cut(exact.groupBy("read_id").agg(F.min_by(F.struct(*HIT[1:]), "rank").alias("m")).select("read_id", "m.*"))
    left = cut(reads.join(first.select("read_id"), "read_id", "left_anti"))
    others = before.unionByName(behind).join(at.select("read_id"), "read_id", "left_semi")
    near = at.unionByName(others).join(first.select("read_id"), "read_id", "left_anti").groupBy("read_id").agg(F.min_by(F.struct(*HIT[1:]), F.struct("hamming", "rank")).alias("near"))
    wide = everywhere_by_join(left, features, m, max_n).select("read_id", F.struct(*HIT[1:]).alias("wide"))
    rest = near.join(wide, "read_id", "full").withColumn("m", F.when(F.col("near").isNull() | (F.col("wide.hamming") < F.col("near.hamming")), F.col("wide")).otherwise(F.col("near")))
    return first.unionByName(rest.where("m.feature_index is not null").select("read_id", "m.*"))


def combine(hits: DataFrame) -> DataFrame:
    """Hits of several reads of one fragment (``source`` tells them apart): the least distance, none if different features tie."""
    return _unique_best(hits.withColumnsRenamed({"match_position": "position", "matched_sequence": "window", "source": "priority"}))


def feature_sequences(hits: DataFrame, *by: str) -> DataFrame:
    """Matched sequences with their count, and feature, distance and position of the first read; by feature, distance, count (falling), sequence. ``by``: columns, such as a sample, within which they are counted."""
    grouped = hits.groupBy(*by, "matched_sequence").agg(F.count("*").alias("n"), F.min_by(F.struct("feature_index", "hamming", "match_position"), "read_id").alias("m"))
    return grouped.select(*by, "matched_sequence", "n", "m.*").orderBy(*by, "feature_index", "hamming", F.desc("n"), "matched_sequence")


def offset_sweep(reads: DataFrame, probes: DataFrame, centre: int, reach: int, k: int = 8) -> DataFrame:
    """Reads with a known k-mer at each offset within ``reach`` of ``centre``: offset, hits, total."""
    places = F.explode(F.sequence(F.lit(max(centre - reach, 0)), F.lit(centre + reach))).alias("offset")
    kmers = reads.select("read_id", "seq", places).select("offset", F.upper(F.substring(F.col("seq"), F.col("offset") + 1, F.lit(k))).alias("variant"))
    known = small(probes.select("variant").distinct().withColumn("known", F.lit(1)))
    return kmers.join(known, "variant", "left").groupBy("offset").agg(F.count("known").alias("hits"), F.count("*").alias("total"))


def anchor_offset(features: DataFrame, guard: float = 0.05) -> DataFrame:
    """Dominant pattern offset, its count, the runner-up's count and ``mixed``: the runner-up has over ``guard`` of the dominant's."""
    counts = features.where("pattern_offset >= 0 and pattern_offset <= 255").groupBy("pattern_offset").agg(F.count("*").alias("n"))
    top = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "pattern_offset"))).alias("a"))
    second = F.coalesce(-F.get("a", F.lit(1))["k"], F.lit(0)).cast("long")
    out = top.select(F.get("a", F.lit(0))["pattern_offset"].alias("pattern_offset"), (-F.get("a", F.lit(0))["k"]).alias("n"), second.alias("runner_up"))
    return out.withColumn("mixed", F.col("runner_up") > guard * F.col("n"))


def constant_offset(features: DataFrame, offset: int | None = None, individual: bool = False) -> int | str | None:
    """The anchor for all features: the one given, OWN with ``individual``, or the dominant one of the patterns; None, for a search everywhere, without patterns.

    An error if both are given, or if patterns disagree (see anchor_offset()) and neither is.
    """
    if individual and offset is not None:
        raise ValueError("individual offsets and a constant offset exclude each other")
    if individual:
        return OWN
    if offset is not None:
        return offset
    found = anchor_offset(features).first()
    if found["mixed"]:
        raise ValueError(f"patterns give several offsets, {found['pattern_offset']} most often: choose a constant offset or individual offsets")
    return found["pattern_offset"]


def modal_length(features: DataFrame) -> DataFrame:
    """Most frequent feature length; of equals the smallest."""
    counts = features.groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("n"))
    return counts.agg(F.max(F.struct("n", (-F.col("length")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("length"), "m.n")
