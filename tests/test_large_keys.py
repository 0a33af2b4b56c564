"""Order keys whose record numbers are beyond 64 bits."""

import os

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
KEPT = ("nation", "customer", "supplier", "part")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Line items in two halves: one as given, one with order keys from 2 ** 30 on."""
    folder = str(tmp_path_factory.mktemp("large"))
    for t in KEPT:
        os.symlink(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    lines = pq.read_table(f"{SMALL}/lineitem.parquet")
    half = lines.slice(0, lines.num_rows // 2)
    at = half.schema.get_field_index("l_orderkey")
    high = half.set_column(at, "l_orderkey", pc.add(half.column("l_orderkey"), 1 << 30))
    pq.write_table(pa.concat_tables([half, high]), f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", os.environ.get("LARGE_KEYS", "aln_filters,aln_cbub_join,aln_last_per_qname,bam_beside_tags,sam_filtered,sidecar_file,demux_probe,sample_files").split(","))
def test_numbers_beyond_64_bits(spark, tables, name):
    con = duckdb.connect()
    for t in (*KEPT, "lineitem"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    sql = __spark_entry__.oracle_sql()[name].replace("(l_orderkey * 8", "(cast(l_orderkey as hugeint) * 8")
    want = con.execute(f"select cast(columns(*) as varchar) from ({sql}) q").fetchall()
    got = __spark_entry__.queries()[name](spark, tables)
    rows = [tuple(None if x is None else str(x).lower() if isinstance(x, bool) else str(x) for x in r) for r in got.collect()]
    key = lambda r: tuple(x or "" for x in r)
    assert rows and sorted(rows, key=key) == sorted(want, key=key)


def test_numbers_that_fit_stay_long(spark):
    assert dict(__spark_entry__.queries()["aln_nh"](spark, SMALL).dtypes)["rec_no"] == "bigint"
