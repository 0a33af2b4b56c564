"""Quality control: per-cell summaries, histograms, matrices, run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyseq.operators.common import cut


def feature_per_cell(dedup: DataFrame) -> DataFrame:
    """barcode, num_features, top_feature_index (0 on a tie), total_deduped_umi."""
    low, high = F.max(F.struct("umis", (-F.col("feature_index")).alias("k"))), F.max(F.struct("umis", "feature_index"))
    per = dedup.groupBy("barcode").agg(F.count("*").alias("num_features"), F.sum("umis").alias("total_deduped_umi"), low.alias("low"), high.alias("high"))
    top = F.when(F.col("high.feature_index") == -F.col("low.k"), F.col("high.feature_index")).otherwise(0)
    return per.select("barcode", "num_features", top.alias("top_feature_index"), "total_deduped_umi")


def count_histogram(dedup: DataFrame) -> DataFrame:
    """feature_index, umis, frequency; feature_index 0 counts over all features."""
    sets = dedup.groupingSets([["feature_index", "umis"], ["umis"]], "feature_index", "umis").agg(F.count("*").alias("frequency"))
    return sets.select(F.coalesce("feature_index", F.lit(0)).alias("feature_index"), "umis", "frequency")


def with_richness(dedup: DataFrame) -> DataFrame:
    """Adds richness: the number of features of the row's barcode."""
    return dedup.withColumn("richness", F.count("*").over(Window.partitionBy("barcode")))


def richness_histogram(dedup: DataFrame) -> DataFrame:
    """richness, barcodes."""
    return dedup.groupBy("barcode").agg(F.count("*").alias("richness")).groupBy("richness").agg(F.count("*").alias("barcodes"))


def feature_richness(dedup: DataFrame) -> DataFrame:
    """feature_index, richness, barcodes and row_max, the largest of the feature."""
    cells = with_richness(dedup).groupBy("feature_index", "richness").agg(F.count("*").alias("barcodes"))
    return cells.withColumn("row_max", F.max("barcodes").over(Window.partitionBy("feature_index")))


def column_sums(cells: DataFrame) -> DataFrame:
    """richness, total: barcodes of that richness (column sums divided by richness)."""
    return cells.groupBy("richness").agg((F.sum("barcodes") / F.col("richness")).cast("long").alias("total"))


def feature_count_matrix(dedup: DataFrame, largest: int) -> DataFrame:
    """feature_index and columns c1 ... c<largest>: barcodes with that many UMIs; the last holds all larger ones, which count_histogram() tells apart."""
    capped = dedup.withColumn("c", F.least("umis", F.lit(largest)))
    wide = capped.groupBy("feature_index").pivot("c", list(range(1, largest + 1))).count().na.fill(0)
    return wide.select("feature_index", *[F.col(str(i)).alias(f"c{i}") for i in range(1, largest + 1)])


def heatmap_rows(dedup: DataFrame, min_total: int = -1) -> DataFrame:
    """feature_index, total of features with a total over max(min_total, 1); no rows if fewer than two are left."""
    totals = dedup.groupBy("feature_index").agg(F.sum("umis").alias("total")).where(F.col("total") > max(min_total, 1))
    return totals.withColumn("rows", F.count("*").over(Window.partitionBy(F.lit(0)))).where("rows >= 2").drop("rows")


def matrix_coo(dedup: DataFrame) -> DataFrame:
    """feature_index, column (1-based rank of the barcode), umis.

    Ranks come from a numbered list of the distinct barcodes, which is far smaller than the matrix. The counts are met three times, so they are made once.
    """
    dedup = cut(dedup)
    return dedup.join(numbered(dedup.select("barcode").distinct(), "barcode", "column"), "barcode").select("feature_index", "column", "umis")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the 1-based rank by ``key`` (distinct), without sorting all rows in one task.

    Rows are dealt by range and numbered within their partition; the partitions' sizes give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number stays as it is wherever the rows are read
    ranged = df.repartitionByRange(parts, F.col(key)).withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count("*").alias("held"), F.min(key).alias("first"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("part"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return ranged.withColumn("inside", inside).join(offsets, "part").withColumn(name, (F.col("before") + F.col("inside")).cast("long")).drop("part", "inside", "before")


def semi(dedup: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of the allowed barcodes."""
    return dedup.join(allowed.select("barcode"), "barcode", "left_semi")


def excluded(dedup: DataFrame, allowed: DataFrame) -> DataFrame:
    """How many barcodes and counts are not allowed: barcodes, umis."""
    return dedup.join(allowed.select("barcode"), "barcode", "left_anti").agg(F.count_distinct("barcode").alias("barcodes"), F.coalesce(F.sum("umis"), F.lit(0)).alias("umis"))


def status_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("status").agg(F.count("*").alias("n"))


def run_stats(reads: DataFrame, raw: DataFrame, dedup: DataFrame, molecules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Run counters from reads(status, feature_index): the numbers of stats.txt and the share of all reads that were assigned; one row, or one for each value of ``by``."""
    key = list(by) or ["one"]
    of = lambda df: df if by else df.withColumn("one", F.lit(1))
    out = of(reads).groupBy(*key).agg(F.count("*").alias("total_reads"), F.count_if(F.expr("feature_index is null")).alias("unmatched_reads"), F.count_if(F.expr("status in ('valid', 'corrected', 'n_corrected', 'rescued')")).alias("assigned_reads"), F.count_if(F.expr("status = 'rescued'")).alias("pending_recovered"))
    names = ("raw_counts", "whitelisted_barcodes", "deduped_counts", "unique_barcode_umis")
    parts = [of(raw).groupBy(*key).agg(F.sum("n").alias(names[0]), F.count_distinct("barcode").alias(names[1])), of(dedup).groupBy(*key).agg(F.sum("umis").alias(names[2])), of(molecules).groupBy(*key).agg(F.count_distinct("barcode", "umi").alias(names[3]))]
    if not by:
        out = reads.sparkSession.range(1).select(F.lit(1).alias("one")).join(out, "one", "left").na.fill(0)
    for p in parts:
        out = out.join(p, key, "left")
    out = out.na.fill(0, list(names))
    share = F.try_divide(F.col("raw_counts") * 100.0, F.col("raw_counts") + F.col("unmatched_reads"))
    return (out if by else out.drop("one")).withColumn("percent_assigned", share).withColumn("percent_of_all", F.try_divide(F.col("assigned_reads") * 100.0, F.col("total_reads")))


def signal_ratio(values: DataFrame, wanted: list[str]) -> DataFrame:
    """Share of value held by the keys wanted: signal, total, ratio."""
    sums = values.agg(F.coalesce(F.sum(F.when(F.col("key").isin(wanted), F.col("value"))), F.lit(0)).alias("signal"), F.sum("value").alias("total"))
    return sums.withColumn("ratio", F.try_divide("signal", "total"))


def conservation(given: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Rows of ``given`` and ``made`` by key, and whether they agree."""
    a, b = given.groupBy(key).agg(F.count("*").alias("given")), made.groupBy(key).agg(F.count("*").alias("made"))
    return a.join(b, key, "full").select(key, F.coalesce("given", F.lit(0)).alias("given"), F.coalesce("made", F.lit(0)).alias("made")).withColumn("equal", F.col("given") == F.col("made"))
