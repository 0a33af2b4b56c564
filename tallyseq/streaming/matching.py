"""Structured Streaming over a landing folder of Parquet reads: stateless search, running counts, cliques by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyseq.operators import match, molecules
from tallyseq.operators.barcode import small


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Reads that land in ``path``, ``per_trigger`` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def assigned(reads: DataFrame, whitelist: DataFrame, features: DataFrame, offset: int | str | None, m: int = 0, max_n: int = 1, reach: int = -1) -> DataFrame:
    """Stream of (barcode, umi, feature_index, read_id): whitelisted barcodes and the features that match.cascade() finds; no state.

    The search is an expression of each read, so any distance, N and anchors go; the features must fit search.MOST_FEATURES.
    """
    cells = small(whitelist.select("barcode"))
    kept = reads.join(cells, "barcode", "left_semi")
    return match.found_in(kept, features, offset, m, max_n, reach).select("barcode", "umi", "feature_index", "read_id")


def running_counts(stream: DataFrame) -> DataFrame:
    """Reads per (barcode, feature_index) so far, for update or complete mode."""
    return molecules.raw_counts(stream)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Reads per feature in windows of event time; rows later than ``late`` are left out, state ends with the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "feature_index").agg(F.count("*").alias("n")).select("window.start", "feature_index", "n")


def collect_molecules(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's molecule counts under batch=<id>, replacing what an earlier try of the same batch left."""

    def write(batch: DataFrame, number: int) -> None:
        molecules.molecule_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, path: str) -> DataFrame:
    """All molecules that collect_molecules() has written, summed over the batches."""
    return spark.read.parquet(path).groupBy("barcode", "umi", "feature_index").agg(F.sum("reads").alias("reads"))
