"""Cliques kept up to date equal those of all reads at once, however the reads are split into batches."""

import random

from tallyseq.operators import molecules
from tallyseq.streaming import cliques, matching

READS = "barcode string, umi string, feature_index int"


def reads(n, seed, barcodes=6):
    rng = random.Random(seed)
    return [(f"C{rng.randrange(barcodes)}", "".join(rng.choice("AC") for _ in range(4)), rng.randint(1, 3)) for _ in range(n)]


def whole(spark, rows):
    return sorted(map(tuple, molecules.cliques(molecules.molecule_counts(spark.createDataFrame(rows, READS)), 4).collect()))


def test_any_split_into_batches(spark, tmp_path):
    rows = reads(90, 1)
    want = whole(spark, rows)
    for k, edges in enumerate(([30, 60], [1, 2, 3, 50])):
        path = f"{tmp_path}/{k}"
        for number, (a, b) in enumerate(zip([0, *edges], [*edges, 90], strict=True)):
            cliques.absorb(spark.createDataFrame(rows[a:b], READS), number, path, 4, buckets=3)
        assert sorted(map(tuple, cliques.current(spark, path).collect())) == want
    dedup = molecules.dedup_counts(molecules.molecule_counts(spark.createDataFrame(rows, READS)), 4, 1, 0)
    assert sorted(map(tuple, cliques.dedup_counts(spark, path, 1, 0).collect())) == sorted(map(tuple, dedup.collect()))


def test_untouched_buckets_and_repeated_batches(spark, tmp_path):
    path, rows = str(tmp_path), reads(60, 2)
    cliques.absorb(spark.createDataFrame(rows, READS), 0, path, 4, buckets=4)
    first = cliques.versions(spark, path)
    files = sorted(p for p in tmp_path.rglob("v=0/**/*.parquet"))
    more = [("C1", "ACAC", 2), ("C1", "ACAA", 2)]
    for _ in range(2):  # the same batch again, as after a lost driver
        cliques.absorb(spark.createDataFrame(more, READS), 1, path, 4, buckets=4)
    now = cliques.versions(spark, path)
    assert sum(v == 1 for v in now.values()) == 1 and {b: v for b, v in now.items() if v == 0}.items() <= first.items()
    assert sorted(p for p in tmp_path.rglob("v=0/**/*.parquet")) == files
    assert {p.parent.name for p in tmp_path.rglob("v=1/**/*.parquet")} == {f"bucket={b}" for b, v in now.items() if v == 1}
    assert sorted(map(tuple, cliques.current(spark, path).collect())) == whole(spark, rows + more)
    cliques.absorb(spark.createDataFrame([(None, "AAAA", 1)], READS), 2, path, 4, buckets=4)
    assert cliques.versions(spark, path) == now


def test_a_stream_of_files(spark, tmp_path):
    rows = reads(80, 3)
    for k in range(4):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], READS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = matching.read_stream(spark, f"{tmp_path}/in/*", READS, 1)
    cliques.follow(stream, f"{tmp_path}/state", f"{tmp_path}/log", 4, buckets=3).awaitTermination()
    assert len(cliques.lists(spark, f"{tmp_path}/state")) == 4
    assert sorted(map(tuple, cliques.current(spark, f"{tmp_path}/state").collect())) == whole(spark, rows)
    assert cliques.current(spark, f"{tmp_path}/none").count() == 0
