"""Small functions that no query shows."""

import json
import re

from pyspark.sql import functions as F

from tallyseq.functions import dna
from tallyseq.operators import qc
from tallyseq.operators.barcode import small
from tallyseq.sinks import files as sinks
from tallyseq.sources import stores, tables


def test_split_without_empty_parts(spark):
    row = spark.range(1).select(dna.split_nonempty(F.lit(",a,,b,"), ",").alias("x"), dna.split_nonempty(F.lit(""), ",").alias("y")).first()
    assert row["x"] == ["a", "b"] and row["y"] == []


def test_axis_is_rounded_up_to_five(spark, tmp_path):
    for rows, top in (([], 5), ([(1, 3)], 5), ([(5, 1)], 5), ([(2, 1), (6, 4)], 10)):
        sinks.put_histogram(spark, rows, f"{tmp_path}/h.html", "t <b>")
        page = (tmp_path / "h.html").read_text()
        assert json.loads(re.search(r'"range": (\[.*?\])', page)[1]) == [0, top] and "<b>" not in page


def test_paths_and_folders(spark, tmp_path):
    assert stores.qualified(spark, f"{tmp_path}//a/../b") == stores.qualified(spark, f"file://{tmp_path}/b") == f"file:{tmp_path}/b"
    sinks.put_text(spark, "x", f"{tmp_path}/new/folder/file")
    assert sinks.exists(spark, f"{tmp_path}/new/folder/file") and not sinks.exists(spark, f"{tmp_path}/new/none")


def test_broadcast_by_bytes(spark):
    rows = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array("id").alias("a"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(rows)) and hinted(small(rows.limit(0))) and not hinted(small(rows, 50_000)) and hinted(small(rows, 200_000))


def test_percent_assigned_without_reads(spark):
    none = spark.createDataFrame([], "status string, feature_index int, barcode string, umi string, n long, umis long")
    row = qc.run_stats(none, none, none, none).first()
    assert row["total_reads"] == 0 and row["percent_assigned"] is None and row["raw_counts"] == 0


def test_whitelist_of_many_splits(spark, tmp_path):
    cells = ["".join("ACGT"[(i >> 2 * k) & 3] for k in range(6)) for i in range(700)]
    (tmp_path / "w").write_text("\n".join(c + ("\n" if i % 5 == 0 else "") for i, c in enumerate(cells)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        rows = tables.whitelist(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["wl_idx"]: r["barcode"] for r in rows} == dict(enumerate(cells, 1))
