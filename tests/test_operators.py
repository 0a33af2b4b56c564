from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyseq.functions import dna
from tallyseq.operators import match, molecules, qc
from tallyseq.plans import assign, registry
from tallyseq.plans.views import TABLES
from tallyseq.streaming import matching

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=str)
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_mutated_last_base_is_matched_at_distance_one(spark):
    """One read, one barcode, one feature whose last base is changed in the read."""
    reads = spark.createDataFrame([(1, "ACGTACGTACGTACGT", "A" * 12, "#" * 16, "ACGTACGTACGTACGTACGA")], "read_id long, barcode string, umi string, barcode_qual string, seq string")
    whitelist = spark.createDataFrame([(1, "ACGTACGTACGTACGT")], "wl_idx long, barcode string")
    features = spark.createDataFrame([(1, "Feat1", "ACGTACGTACGTACGTACGT")], "feature_index int, name string, sequence string")
    assert [(r["hamming"], r["match_position"]) for r in match.cascade(reads, features, None, 1).collect()] == [(1, 0)]
    out = assign.assign_barcodes(reads, whitelist, features, min_counts=0, max_n_feature=1)
    assert [tuple(r) for r in out["dedup"].collect()] == [("ACGTACGTACGTACGT", 1, 1)]
    stats = out["stats"].first()
    assert (stats["raw_counts"], stats["deduped_counts"], stats["total_reads"], stats["percent_assigned"]) == (1, 1, 1, 100.0)


@pytest.mark.parametrize(("stringency", "want"), [(0, {1, 2}), (1, {1}), (500, {1}), (800, set()), (1000, set())])
def test_clique_votes(spark, stringency, want):
    reads = spark.createDataFrame([("b", "u", 1, 3), ("b", "u", 2, 1)], "barcode string, clique_id string, feature_index int, reads long")
    assert {r["feature_index"] for r in molecules.clique_votes(reads, stringency, 0).collect()} == want
    if stringency == 1000:
        assert {r["feature_index"] for r in molecules.clique_votes(reads, stringency, 0, strict=True).collect()} == {1}


def test_votes_without_a_single_winner_or_enough_reads(spark):
    tie = spark.createDataFrame([("b", "u", 1, 2), ("b", "u", 2, 2), ("c", "u", 1, 1)], "barcode string, clique_id string, feature_index int, reads long")
    assert molecules.clique_votes(tie, 1, 1).count() == 0


@pytest.mark.parametrize("limit", [10_000, 0])
def test_cliques_both_ways(spark, limit):
    rng = np.random.default_rng(1)
    rows = list({("b%d" % rng.integers(3), "".join(rng.choice(list("ACGT"), 5)), int(rng.integers(1, 3))) for _ in range(300)})
    got = {(r["barcode"], r["clique_id"], r["feature_index"]): r["reads"] for r in molecules.cliques(spark.createDataFrame([(*r, 2) for r in rows], "barcode string, umi string, feature_index int, reads long"), 5, pandas_limit=limit).collect()}
    root = {(b, u): u for b, u, _ in rows}
    find = lambda b, u: u if root[b, u] == u else find(b, root[b, u])
    for (b, u), (c, v) in combinations(sorted(root), 2):
        if b == c and sum(x != y for x, y in zip(u, v, strict=True)) == 1:
            x, y = sorted((find(b, u), find(b, v)))
            root[b, y] = x
    want = Counter()
    for b, u, f in rows:
        want[b, find(b, u), f] += 2
    assert got == want


def test_ties_between_features_reject(spark):
    features = spark.createDataFrame([(1, "ACGTAC"), (2, "ACGTAA")], "feature_index int, sequence string")
    reads = spark.createDataFrame([(1, "ACGTAG"), (2, "ACGTAC"), (3, "ACTTAC"), (4, "TTTTTT")], "read_id long, seq string")
    assert {r["read_id"]: r["feature_index"] for r in match.fuzzy_at(reads, features, 0, 1).collect()} == {2: 1, 3: 1}


def test_nothing_in_nothing_out(spark):
    features = spark.createDataFrame([(1, "ACGTAC")], "feature_index int, sequence string")
    reads = spark.createDataFrame([], "read_id long, seq string")
    assert match.cascade(reads, features, 2, 1).count() == 0
    assert qc.feature_per_cell(spark.createDataFrame([], "barcode string, feature_index int, umis long")).count() == 0


def test_dna_functions(spark):
    row = spark.createDataFrame([("AAAAAAACCAAAAAAA", "ANNC", None)], "a string, n string, x string").select(dna.translate_nxt(F.col("a")), dna.expand_n(F.col("n"), 2), dna.reverse_complement(F.col("x")), dna.encode(F.col("x"))).first()
    assert row[0] == "AAAAAAAGGAAAAAAA" and row[1][:5] == ["AAAC", "AACC", "AAGC", "AATC", "ACAC"] and len(row[1]) == 16 and row[2] is None and row[3] is None


def test_top_feature_tie_is_zero(spark):
    rows = spark.createDataFrame([("b", 1, 2), ("b", 2, 2), ("c", 3, 1)], "barcode string, feature_index int, umis long")
    assert {r["barcode"]: r["top_feature_index"] for r in qc.feature_per_cell(rows).collect()} == {"b": 0, "c": 3}


def test_numbering_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 100003 as k")
    got = {r["k"]: r["n"] for r in qc.numbered(rows, "k", "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))}


def test_streams_agree_with_batches(spark, tmp_path):
    schema = "read_id long, barcode string, umi string, seq string"
    rows = [(i, ("AAAA", "CCCC", "GGGG")[i % 3], ("AC", "GT")[i % 2], "TT" + ("ACGT", "GGCC")[i % 2]) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    whitelist = spark.createDataFrame([("AAAA",), ("CCCC",)], "barcode string")
    features = spark.createDataFrame([(1, "ACGT"), (2, "GGCC")], "feature_index int, sequence string")
    stream = matching.assigned(matching.read_stream(spark, f"{tmp_path}/in/*", schema, 1), whitelist, features, 2)
    matching.collect_molecules(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    batch = molecules.molecule_counts(matching.assigned(spark.createDataFrame(rows, schema), whitelist, features, 2))
    key = lambda df: sorted(tuple(r) for r in df.select("barcode", "umi", "feature_index", "reads").collect())
    assert key(matching.settled(spark, f"{tmp_path}/out")) == key(batch)


@pytest.mark.parametrize("strict", [False, True])
def test_cliques_of_odd_umis_and_without_neighbour_rows(spark, strict):
    """UMIs with N, of other lengths and null: the same cliques by barcode and by joins; no row for each neighbour."""
    rng = np.random.default_rng(2)
    umis = ["".join(rng.choice(list("ACGTN"), rng.integers(3, 6), p=[0.3, 0.3, 0.2, 0.1, 0.1])) for _ in range(150)]
    rows = [(f"b{i % 3}" if i % 50 else None, u if i % 40 else None, int(i % 2), 1) for i, u in enumerate([*umis, *umis[:40]])]
    df = spark.createDataFrame(rows, "barcode string, umi string, feature_index int, reads long")
    df = df.groupBy("barcode", "umi", "feature_index").agg(F.sum("reads").alias("reads"))
    near = molecules.cliques(df, 4, strict)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(near.collect(), key=key) == sorted(molecules.cliques(df, 4, strict, pandas_limit=0).collect(), key=key)
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
