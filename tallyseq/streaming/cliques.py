"""UMI cliques kept up to date: each micro-batch recomputes the barcodes that it touches.

The state is two tables, molecules and cliques, dealt by a hash of the barcode into buckets. A batch writes the buckets it touches under its own number, v=<batch>, and then
a list that says for each bucket which batch wrote it last. Readers go by the newest list, a batch by the newest of an earlier
one; so a batch that runs again starts from the same state, and buckets without new reads are not rewritten.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyseq.operators import molecules
from tallyseq.operators.common import cut
from tallyseq.sinks import files as sinks

MOLECULES = "barcode string, umi string, feature_index int, reads long"
CLIQUES = "barcode string, clique_id string, feature_index int, reads long"


def lists(spark: SparkSession, path: str) -> dict[int, str]:
    """Batch and place of the lists that are there."""
    fs, where = sinks._path(spark, f"{path}/lists")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return {int(n.removesuffix(".json")): f"{path}/lists/{n}" for n in names if n.endswith(".json")}


def versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """For each bucket the batch that wrote it last, or did so before a batch."""
    there = {n: p for n, p in lists(spark, path).items() if before is None or n < before}
    if not there:
        return {}
    text = "\n".join(r["value"] for r in spark.read.text(there[max(there)]).collect())
    return {int(bucket): version for bucket, version in json.loads(text).items()}


def stored(spark: SparkSession, path: str, table: str, schema: str, of: dict[int, int]) -> DataFrame:
    """The rows of a table in some buckets; a row of none where there are no buckets."""
    places = [f"{path}/{table}/v={version}/bucket={bucket}" for bucket, version in of.items()]
    places = [p for p in places if sinks.exists(spark, p)]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def absorb(batch: DataFrame, number: int, path: str, umi_length: int, buckets: int = 64, strict: bool = False) -> None:
    """Brings the state up to date with the reads(barcode, umi, feature_index) of a batch.

    Only barcodes of the batch are grouped into cliques again; the others of their buckets are carried over as they are. A batch without reads
    leaves the state alone. A batch number that comes again replaces what its earlier try left.
    """
    spark = batch.sparkSession
    bucket = lambda c: F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(buckets)).cast("int")
    new = cut(molecules.molecule_counts(batch.where("barcode is not null")).select("barcode", "umi", F.col("feature_index").cast("int").alias("feature_index"), "reads"))
    touched = sorted(r[0] for r in new.select(bucket("barcode")).distinct().collect())
    before = versions(spark, path, number)
    if not touched:
        return
    held = {b: v for b, v in before.items() if b in set(touched)}
    merged = stored(spark, path, "molecules", MOLECULES, held).unionByName(new).groupBy("barcode", "umi", "feature_index").agg(F.sum("reads").alias("reads"))
    merged.withColumn("bucket", bucket("barcode")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/molecules/v={number}")
    after = before | {b: number for b in touched}
    names = new.select("barcode").distinct()
    again = stored(spark, path, "molecules", MOLECULES, {b: number for b in touched}).join(names, "barcode", "left_semi")
    kept = stored(spark, path, "cliques", CLIQUES, held).join(names, "barcode", "left_anti")
    found = molecules.cliques(again, umi_length, strict).select("barcode", "clique_id", "feature_index", "reads").unionByName(kept)
    found.withColumn("bucket", bucket("barcode")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/cliques/v={number}")
    sinks.put_text(spark, json.dumps(after), f"{path}/lists/{number}.tmp")
    fs, made = sinks._path(spark, f"{path}/lists/{number}.tmp")
    _, where = sinks._path(spark, f"{path}/lists/{number}.json")
    fs.delete(where, False)
    fs.rename(made, where)


def follow(stream: DataFrame, path: str, checkpoint: str, umi_length: int, buckets: int = 64, strict: bool = False) -> StreamingQuery:
    """Keeps the state under ``path`` up to date with a stream of reads(barcode, umi, feature_index)."""
    return stream.writeStream.foreachBatch(lambda batch, number: absorb(batch, number, path, umi_length, buckets, strict)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, clique_id, feature_index, reads) of all reads so far, as molecules.cliques() gives them."""
    return stored(spark, path, "cliques", CLIQUES, versions(spark, path))


def dedup_counts(spark: SparkSession, path: str, stringency: int = 1, min_counts: int = 1, strict: bool = False) -> DataFrame:
    """(barcode, feature_index, umis) of all reads so far."""
    return molecules.clique_votes(current(spark, path), stringency, min_counts, strict)
