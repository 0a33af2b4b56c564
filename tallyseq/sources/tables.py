"""Small dimension tables from text: whitelist, features, probes, sample map, filter list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyseq.functions import dna
from tallyseq.sources.fastq import numbered_lines


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, over all lines) and value of one text file.

    These files are dictionaries; each is read as one split, so the row number of the split is the line.
    """
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).select((F.col("line_no") + 1).cast("long").alias("line_no"), "value")


def _fields(df: DataFrame) -> DataFrame:
    return df.where(F.btrim("value") != "").withColumn("f", F.split(F.trim("value"), r"[\t \r\n]+"))


def whitelist(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """wl_idx (1-based among the non-empty lines, however many splits the file has), barcode, code; duplicates keep the first line. Other than ACGT, or mixed lengths: an error."""
    rows = numbered_lines(spark, [path], F.btrim("value") != "").select((F.col("line") + 1).alias("wl_idx"), F.btrim("value").alias("barcode"))
    any_line = rows.select(F.length("barcode")).first()
    same = F.length("barcode") == (any_line[0] if any_line else 0)
    checked = F.when(dna.is_dna(F.col("barcode")) & same, F.col("barcode")).otherwise(F.raise_error(F.concat(F.lit("bad whitelist line: "), "barcode")))
    rows = rows.select("wl_idx", (dna.reverse_complement(checked) if reverse else checked).alias("barcode"))
    return rows.groupBy("barcode").agg(F.min("wl_idx").alias("wl_idx")).select("wl_idx", "barcode", dna.encode(F.col("barcode")).alias("code"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """feature_index (row order from 1), name, sequence, length, pattern, pattern_offset; columns are found by header name. A sequence other than ACGT is an error."""
    raw = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in raw.columns}
    if not {"name", "sequence"} <= set(names):
        raise ValueError("the feature list needs columns name and sequence")
    pattern = F.col(names["pattern"]) if "pattern" in names else F.lit(None).cast("string")
    rows = raw.select(F.monotonically_increasing_id().alias("at"), F.col(names["name"]).alias("name"), F.col(names["sequence"]).alias("sequence"), pattern.alias("pattern"))
    checked = F.when(dna.is_dna(F.col("sequence")), F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("bad feature sequence: "), F.coalesce("sequence", F.lit("")))))
    index = F.row_number().over(Window.orderBy("at"))
    return rows.select(index.alias("feature_index"), "name", checked.alias("sequence"), F.length("sequence").alias("length"), "pattern", F.coalesce(dna.pattern_offset(F.col("pattern")), F.lit(-1)).alias("pattern_offset"))


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Filter list: barcode."""
    return spark.read.text(path).select(F.btrim("value").alias("barcode")).where("barcode <> ''").distinct()


def probes(spark: SparkSession, path: str, grouped: bool = False, k: int = 8) -> DataFrame:
    """variant, canonical, probe_name, probe_index from variant, canonical, id; rows with a bad variant are skipped.

    probe_index: the row's order, or with ``grouped`` the alphabetical rank of its id (canonical is then the id's first).
    """
    rows = _fields(lines(spark, path)).where(F.size("f") >= 3).select("line_no", F.upper(F.get("f", F.lit(0))).alias("variant"), F.get("f", F.lit(1)).alias("canonical"), F.get("f", F.lit(2)).alias("probe_name"))
    rows = rows.where((F.length("variant") == k) & dna.is_dna(F.col("variant")))
    if grouped:
        canonical = F.first("canonical").over(Window.partitionBy("probe_name").orderBy("line_no"))
        return rows.select("variant", canonical.alias("canonical"), "probe_name", F.dense_rank().over(Window.orderBy("probe_name")).alias("probe_index"))
    return rows.select("variant", "canonical", "probe_name", F.row_number().over(Window.orderBy("line_no")).alias("probe_index"))


def sample_map(spark: SparkSession, path: str) -> DataFrame:
    """library_id, probe_name, sample after the header line; of repeated keys the last counts."""
    rows = _fields(lines(spark, path)).where(F.size("f") >= 3)
    rows = rows.withColumn("n", F.row_number().over(Window.orderBy("line_no"))).where("n > 1")
    return rows.groupBy(F.get("f", F.lit(0)).alias("library_id"), F.get("f", F.lit(1)).alias("probe_name")).agg(F.max_by(F.get("f", F.lit(2)), "line_no").alias("sample"))
