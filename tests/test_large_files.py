"""Files of many rows: what is shuffled, written twice or read by one task."""

import os
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyseq.plans import roundtrips
from tallyseq.sinks import files as sinks
from tallyseq.sources import alignments


@contextmanager
def settings(spark, **given):
    """Settings of Spark's SQL, their names after spark.sql. with two underscores for a dot."""
    new = {f"spark.sql.{k.replace('__', '.')}": v for k, v in given.items()}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sam_lines_meet_no_join(spark, tmp_path):
    """Lines of SAM text are numbered without a shuffle, however small the tables that may be broadcast; header and empty lines count nowhere."""
    line = lambda i: f"q{i}\t{i % 5}\tc1\t1\t30\t4M\t*\t0\t0\tACGT\t*\tNH:i:{i}\n"
    (tmp_path / "x.sam").write_text("@HD\tVN:1\n\n@SQ\tSN:c1\n" + "".join(line(i) + ("\n" if i % 100 == 0 else "") for i in range(2000)))
    with settings(spark, autoBroadcastJoinThreshold="-1", files__maxPartitionBytes="10000"):
        df = alignments.read_sam(spark, f"{tmp_path}/x.sam")
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows, first = df.collect(), alignments.read_sam(spark, f"{tmp_path}/x.sam", 3).count()
        parts = df.rdd.getNumPartitions()
    assert "SortMergeJoin" not in plan and parts > 1
    assert sorted((r["rec_no"], r["qname"], r["nh"]) for r in rows) == [(i, f"q{i}", i) for i in range(2000)] and first == 3


@pytest.mark.parametrize("root", ["", "viewfs://shelf"])
def test_text_stands_once(spark, tmp_path, root):
    """The parts of a file of lines are gzip, whatever their number; the file is plain, also where only Spark writes."""
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.shelf.link.{tmp_path}", f"file:{tmp_path}")
    n, text = 20_000, "the same words in each line, and the number "
    rows = spark.range(n, numPartitions=7).select(F.concat(F.lit(text), "id").alias("value"), (-F.col("id")).alias("k"))
    with settings(spark, adaptive__coalescePartitions__enabled="false"):
        sinks.write_lines(rows, f"{root}{tmp_path}/x.txt", "k", head="head\n")
        sinks.write_lines(rows.limit(0), f"{root}{tmp_path}/none.txt", "k", head="head\n")
        sinks.write_lines(rows.where("k = -5"), f"{root}{tmp_path}/one.txt")
    assert (tmp_path / "x.txt").read_text() == "head\n" + "".join(f"{text}{i}\n" for i in range(n - 1, -1, -1))
    assert (tmp_path / "none.txt").read_text() == "head\n" and (tmp_path / "one.txt").read_text() == f"{text}5\n"
    parts = [p.stat().st_size for p in (tmp_path / "x.txt.parts").glob("part-*")]
    assert len(parts) > 1 and sum(parts) < os.path.getsize(tmp_path / "x.txt") / 3


def test_written_lines_are_read_by_splits(spark, tmp_path):
    """lines_of(): several tasks read a file, and numbers run over all of its lines."""
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(1, 3001)))
    with settings(spark, files__maxPartitionBytes="5000"):
        rows = roundtrips.lines_of(spark, f"{tmp_path}/x.txt").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["line_no"], r["value"]) for r in rows) == [(i, f"line {i}") for i in range(1, 3001) if i % 7]
    assert len({r["task"] for r in rows}) > 3


def test_tap_is_read_by_splits(spark):
    """nh_debug_file: the log of all counted records is read by several tasks, none of which holds it whole."""
    df = __spark_entry__.queries()["nh_debug_file"](spark, "/root/testdata/sf0.001")
    with settings(spark, files__maxPartitionBytes="10000"):
        tap = df.where("event = 'nh_tap'").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["index"] for r in tap) == list(range(len(tap))) and len({r["task"] for r in tap}) > 1


def test_heads_meet_filters_on_numbers(spark, tmp_path):
    """fields() of lines_of(): a join by a number may ask the lines of the head for theirs before they are left out."""
    (tmp_path / "x.txt").write_text("name number\n" + "".join(f"n{i} {i}\n" for i in range(50)))
    rows = roundtrips.fields(roundtrips.lines_of(spark, f"{tmp_path}/x.txt").where("line_no > 1"), " ", name="string", number="long")
    joined = rows.join(spark.range(10).withColumnRenamed("id", "number"), "number").collect()
    assert sorted((r["number"], r["name"]) for r in joined) == [(i, f"n{i}") for i in range(10)]
