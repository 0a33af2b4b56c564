"""Cell barcodes: exact and one-mismatch whitelist joins, N rescue, posterior rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyseq.functions import dna
from tallyseq.operators.common import cut

BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a table of at most ``most`` bytes, a bound from its rows and the length of its texts; a larger one keeps the planner's choice.

    Counting stops at the number of rows that alone would be too many. The table is made for it once, so give what is stored or cheap.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) + 24 if t == "string" else F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) + 24 if t.startswith(("struct", "array", "map")) else F.lit(16) for c, t in df.dtypes), F.lit(16))
    seen = df.select(width.cast("long").alias("bytes")).limit(most // 16 + 1)
    held = seen.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= most else df


def split_read(reads: DataFrame, barcode_length: int = 16, umi_length: int = 12, start: int = 0) -> DataFrame:
    """Adds barcode, umi and the barcode's qualities; null where the read is too short."""
    return reads.withColumns({
        "barcode": dna.cut_out(F.col("r1_seq"), start, barcode_length),
        "umi": F.when(F.length("r1_seq") >= start + barcode_length + umi_length, F.substring("r1_seq", start + barcode_length + 1, umi_length)),
        "barcode_qual": dna.cut_out(F.col("r1_qual"), start, barcode_length),
    })


def exact(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Reads whose barcode is on the whitelist."""
    return reads.join(small(whitelist.select("barcode")), "barcode", "left_semi")


def one_mismatch(barcodes: DataFrame, whitelist: DataFrame, length: int) -> DataFrame:
    """Candidates (barcode, candidate, pos) at distance one of the distinct ``barcodes(barcode)``.

    Only the distinct barcodes are spelled out into their 3 * length neighbours, then joined by equality.
    """
    near = barcodes.select("barcode").distinct().where(dna.is_dna(F.col("barcode"))).select("barcode", F.explode(dna.neighbours(F.col("barcode"), length)).alias("x"))
    near = near.select("barcode", F.col("x.sequence").alias("candidate"), F.col("x.pos").alias("pos"))
    return near.join(small(whitelist.select(F.col("barcode").alias("candidate"))), "candidate", "left_semi")


def n_rescue(barcodes: DataFrame, whitelist: DataFrame, max_n: int = 1) -> DataFrame:
    """(barcode, candidate) of barcodes with N whose expansions hit the whitelist exactly once; fewer than ``max_n`` N."""
    with_n = barcodes.select("barcode").distinct().where(F.col("barcode").contains("N") & dna.within_n_budget(F.col("barcode"), max_n))
    spelled = with_n.select("barcode", F.explode(dna.expand_n(F.col("barcode"), max(max_n - 1, 0))).alias("candidate"))
    hit = spelled.join(small(whitelist.select(F.col("barcode").alias("candidate"))), "candidate", "left_semi")
    return hit.groupBy("barcode").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).where("n = 1").drop("n")


def corrections(reads: DataFrame, whitelist: DataFrame, length: int, max_n: int = 1) -> DataFrame:
    """(barcode, near, from_n) of the distinct barcodes that are not on the whitelist: candidates at distance one, and the one from N.

    The table is materialised: reads meet it several times.
    """
    unknown = cut(reads.where("barcode is not null").select("barcode").distinct().join(whitelist.select("barcode"), "barcode", "left_anti"))
    near = one_mismatch(unknown, whitelist, length).groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct("candidate", "pos"))).alias("near"))
    rescued = n_rescue(unknown, whitelist, max_n).withColumnRenamed("candidate", "from_n")
    return cut(unknown.join(near, "barcode", "left").join(rescued, "barcode", "left").withColumn("unknown", F.lit(True)))


def classify(reads: DataFrame, whitelist: DataFrame, length: int, max_candidates: int = 3, max_n: int = 1, table: DataFrame | None = None) -> DataFrame:
    """Adds status, corrected (barcode) and candidates to ``reads(read_id, barcode, umi, barcode_qual, ...)``.

    status: short (no barcode or UMI), bad_umi (other than ACGT), valid, corrected (one candidate at distance one), pending (two to
    ``max_candidates``), ambiguous (more), n_corrected, no_match. ``table``: what corrections() gave, if it is at hand; broadcast where it is
    small, so that reads are not shuffled.
    """
    out = reads.join(small(corrections(reads, whitelist, length, max_n) if table is None else table), "barcode", "left")
    n = F.coalesce(F.size("near"), F.lit(0))
    bad = F.col("barcode").isNull() | F.col("umi").isNull()
    status = (
        F.when(bad, "short").when(~dna.is_dna(F.col("umi")), "bad_umi").when(F.col("unknown").isNull(), "valid").when(F.col("from_n").isNotNull(), "n_corrected")
        .when(n == 1, "corrected").when((n > 1) & (n <= max_candidates), "pending").when(n > max_candidates, "ambiguous").otherwise("no_match")
    )
    out = out.withColumn("status", status)
    corrected = F.when(F.col("status") == "valid", F.col("barcode")).when(F.col("status") == "n_corrected", F.col("from_n")).when(F.col("status") == "corrected", F.col("near")[0]["candidate"])
    return out.withColumn("corrected", corrected).withColumn("candidates", F.when(F.col("status") == "pending", F.col("near"))).drop("near", "from_n", "unknown")


def evidence(pending: DataFrame, totals: DataFrame) -> DataFrame:
    """(read_id, candidate, posterior): (1 + reads of the candidate) * error probability at the mismatch, normalised within the read.

    ``pending(read_id, barcode_qual, candidates)``, ``totals(barcode, n)``: counts before any rescue, so the result
    does not depend on the order of reads.
    """
    rows = pending.select("read_id", "barcode_qual", F.explode("candidates").alias("c")).select("read_id", F.col("c.candidate").alias("candidate"), dna.error_probability(F.substring(F.col("barcode_qual"), F.col("c.pos") + 1, F.lit(1))).alias("p"))
    joined = rows.join(totals.select(F.col("barcode").alias("candidate"), F.col("n").alias("raw")), "candidate", "left")
    weight = (1 + F.coalesce("raw", F.lit(0))) * F.col("p")
    weighed = joined.withColumn("w", weight)
    return weighed.select("read_id", "candidate", (F.col("w") / F.sum("w").over(Window.partitionBy("read_id"))).alias("posterior"))


def rescue(pending: DataFrame, totals: DataFrame, min_posterior: float = 0.975) -> DataFrame:
    """(read_id, candidate, posterior) of pending reads with a candidate strictly above ``min_posterior``."""
    return evidence(pending, totals).where(F.col("posterior") > min_posterior)


def correct(reads: DataFrame, whitelist: DataFrame, length: int, max_candidates: int = 3, max_n: int = 1, min_posterior: float = 0.975, by: tuple[str, ...] = ()) -> DataFrame:
    """classify(), then rescue of pending reads by posterior: status rescued, or rejected.

    The posterior is that of evidence(). Counts are joined to the candidates of the distinct pending barcodes; a read then weighs its few
    candidates by itself, so reads are joined by barcode only, with tables that are broadcast where they are small. ``by``: columns, such as a
    sample, within which reads are counted, each for itself.
    """
    table = corrections(reads, whitelist, length, max_n)
    classed = classify(reads, whitelist, length, max_candidates, max_n, table)
    totals = classed.where("corrected is not null").groupBy(*by, F.col("corrected").alias("candidate")).agg(F.count("*").alias("raw"))
    several = table.where(F.size("near").between(2, max_candidates) & F.col("from_n").isNull()).select("barcode", F.explode("near").alias("c")).select("barcode", "c.*")
    if by:
        several = several.join(classed.where("status = 'pending'").select(*by, "barcode").distinct(), "barcode")
    weighed = several.join(totals, [*by, "candidate"], "left").groupBy(*by, "barcode").agg(F.array_sort(F.collect_list(F.struct("candidate", "pos", F.coalesce("raw", F.lit(0)).alias("raw")))).alias("weighed"))
    out = classed.join(small(cut(weighed)), [*by, "barcode"], "left")
    chance = lambda c: (1 + c["raw"]) * dna.error_probability(F.substring(F.col("barcode_qual"), c["pos"] + 1, F.lit(1)))
    whole = F.aggregate("weighed", F.lit(0.0), lambda a, c: a + chance(c))
    out = out.withColumn("whole", F.when(F.col("status") == "pending", whole))
    saved = F.get(F.filter("weighed", lambda c: chance(c) / F.col("whole") > min_posterior), F.lit(0))["candidate"]
    out = out.withColumn("saved", F.when(F.col("status") == "pending", saved)).drop("weighed", "whole")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("saved").isNotNull(), "rescued").otherwise("rejected")
    return out.withColumn("status", status).withColumn("corrected", F.coalesce("corrected", "saved")).drop("saved")


def positional_qualities(qual: Column) -> Column:
    """Phred values of a quality string."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)
