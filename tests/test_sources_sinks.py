import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallyseq.operators import demux
from tallyseq.plans import assign
from tallyseq.sinks import files as sinks
from tallyseq.plans import roundtrips
from tallyseq.sources import alignments, fastq, files, tables


def write_fastq(path, seqs, cut=0):
    text = "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))
    text = text[: len(text) - cut] if cut else text
    (gzip.open if str(path).endswith("gz") else open)(path, "wt").write(text)
    return str(path)


def test_fastq_pairs(spark, tmp_path):
    r1, r2 = [f"ACGT{'ACGT'[i % 4]}" for i in range(7)], [f"TT{'ACGT'[i % 4]}" for i in range(5)]
    sets = [{"sample": "s", "lane": "0", "r1": write_fastq(tmp_path / "a_R1_.fastq.gz", r1), "r2": write_fastq(tmp_path / "a_R2_.fastq", r2)}]
    rows = fastq.reads(fastq.read_fastq(spark, sets)).orderBy("read_id").collect()
    assert [(r["read_id"], r["r1_seq"], r["r2_seq"], r["r3_seq"]) for r in rows] == [(i, r1[i], r2[i], None) for i in range(5)]
    assert fastq.read_fastq(spark, sets, max_reads=2).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        fastq.read_fastq(spark, sets, strict=True).collect()


def test_fastq_split_files_keep_their_numbering(spark, tmp_path):
    seqs = ["ACGT"[i % 4] * 20 for i in range(500)]
    path = write_fastq(tmp_path / "b_R1_.fastq", seqs)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = fastq.read_fastq(spark, [{"sample": "s", "lane": "0", "r1": path}]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["read_id"]: r["r1"]["seq"] for r in rows} == dict(enumerate(seqs))


def test_planning(tmp_path):
    for d, n in (("x", 10), ("y", 50)):
        (tmp_path / d).mkdir()
        for mate in ("R1", "R2"):
            (tmp_path / d / f"SC12_L001_{mate}_001.fastq").write_text("@\n" * n)
    sets = files.by_directory(str(tmp_path))
    assert [s["sample"] for s in sets] == ["y", "x"] and sets[0]["r3"] is None
    assert files.sample_of("/a/lib_L002_R1_001.fastq", "_R1_") == "lib"
    names = files.by_name(["a_L1_R1_.fq", "a_L2_R1_.fq", "b_R1_.fq"], ["a_L1_R2_.fq", "a_L2_R2_.fq", "b_R2_.fq"], [])
    assert [(s["sample"], s["lane"]) for s in names] == [("a", "0"), ("a", "1"), ("b", "0")]
    assert {s["sample"] for s in files.by_name(["a_R1_", "b_R1_"], ["a_R2_", "b_R2_"], [], merge_all=True)} == {"sample"}
    with pytest.raises(ValueError, match="as many"):
        files.check_counts(["a"], ["b", "c"], [])


def test_tables(spark, tmp_path):
    (tmp_path / "w").write_text("ACGT\n\nTTTT\nACGT\n")
    assert {tuple(r) for r in tables.whitelist(spark, f"{tmp_path}/w").collect()} == {(1, "ACGT", 27), (2, "TTTT", 255)}
    assert {r["barcode"] for r in tables.whitelist(spark, f"{tmp_path}/w", reverse=True).collect()} == {"ACGT", "AAAA"}
    (tmp_path / "bad").write_text("ACGN\n")
    with pytest.raises(Exception, match="bad whitelist"):
        tables.whitelist(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "f.csv").write_text('id,name,pattern,sequence\n1,"A,1",5PNN(BC),ACGT\n2,B,,GGGG\n')
    rows = tables.features(spark, f"{tmp_path}/f.csv").orderBy("feature_index").collect()
    assert [(r["feature_index"], r["name"], r["pattern_offset"]) for r in rows] == [(1, "A,1", 4), (2, "B", -1)]
    (tmp_path / "p").write_text("ACGTACGT ACGTACGT BC002\nshort x BC009\nAAAACCCC\tAAAACCCC\tBC001\nTTTTACGT ACGTACGT BC002\n")
    assert [(r["probe_name"], r["probe_index"]) for r in tables.probes(spark, f"{tmp_path}/p").orderBy("probe_index").collect()] == [("BC002", 1), ("BC001", 2), ("BC002", 3)]
    assert {(r["variant"], r["canonical"], r["probe_index"]) for r in tables.probes(spark, f"{tmp_path}/p", grouped=True).collect()} == {("ACGTACGT", "ACGTACGT", 2), ("TTTTACGT", "ACGTACGT", 2), ("AAAACCCC", "AAAACCCC", 1)}
    (tmp_path / "m").write_text("lib probe sample\nSC1 BC001 one\nSC1 BC001 two\n")
    assert [tuple(r) for r in tables.sample_map(spark, f"{tmp_path}/m").collect()] == [("SC1", "BC001", "two")]


def bam(path, records):
    body = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)
    for name, flag, mapq, seq, tags in records:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        aux = b"".join(k.encode() + (b"i" + struct.pack("<i", v) if isinstance(v, int) else b"Z" + v.encode() + b"\0") for k, v in tags.items())
        r = struct.pack("<iiBBHHHiiii", 0, 0, len(name) + 1, mapq, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + b"\xff" * len(seq) + aux
        body += struct.pack("<i", len(r)) + r
    out = b""
    for at in range(0, len(body), 50):  # many small gzip members
        z = zlib.compressobj(wbits=31)
        out += z.compress(body[at : at + 50]) + z.flush()
    path.write_bytes(out)


RECORDS = [("q1", 0, 30, "GGACGTACGTT", {"CB": "c1", "UB": "AA", "GX": "g1", "NH": 2}), ("q1", 16, 30, "AACGTACGTCC", {"CB": "c1", "UB": "AC", "GE": "g2"}), ("q2", 256, 30, "GGACGTACGTT", {"CB": "c1", "UB": "AA", "GX": "g1"}), ("q3", 0, 30, "GGACGTACGTT", {"CB": "-", "UB": "AA", "GX": "g1"}), ("q4", 0, 30, "GGACGTACGTT", {"UB": "AA"}), ("q5", 0, 30, "GGGACGTACGTT", {"CB": "c2", "UB": "AA", "GX": "g1"})]


def test_bam_and_sam_agree(spark, tmp_path):
    alignments.register(spark)
    bam(tmp_path / "x.bam", RECORDS)
    got = spark.read.format("tally_bam").load(f"{tmp_path}/x.bam").orderBy("rec_no").collect()
    assert [(r["qname"], r["flag"], r["mapq"], r["seq"], r["nh"]) for r in got] == [(n, f, m, s, t.get("NH")) for n, f, m, s, t in RECORDS]
    sam = "@HD\tVN:1\n" + "".join(f"{n}\t{f}\tc1\t1\t{m}\t{len(s)}M\t*\t0\t0\t{s}\t*" + "".join(f"\t{k}:{'i' if isinstance(v, int) else 'Z'}:{v}" for k, v in t.items()) + "\n" for n, f, m, s, t in RECORDS)
    (tmp_path / "x.sam").write_text(sam)
    assert alignments.read_sam(spark, f"{tmp_path}/x.sam").orderBy("rec_no").collect() == got
    assert alignments.read_sam(spark, f"{tmp_path}/x.sam", 2).count() == 2


def test_bam_program(spark, tmp_path):
    alignments.register(spark)
    bam(tmp_path / "x.bam", RECORDS)
    probes = spark.createDataFrame([("ACGTACGT", "BC001", 1)], "variant string, probe_name string, probe_index int")
    rows = spark.read.format("tally_bam").load(f"{tmp_path}/x.bam")
    out = assign.demux_bam(rows, probes, offset=2)
    assert [tuple(r) for r in out["counts"].collect()] == [("c1", 1, 2)]
    assert out["stats"].first().asDict() == {"total_reads": 4, "countable_reads": 3, "counted": 2, "cells": 1, "entries": 1}
    assert {tuple(r) for r in assign.demux_bam(rows, probes, offset=2, nearby=True)["counts"].collect()} == {("c1", 1, 2), ("c2", 1, 1)}
    assert {r["qname"]: r["gene"] for r in out["last"].collect()} == {"q1": "g2", "q5": "g1"}


def test_tag_stream(spark, tmp_path):
    alignments.register(spark)
    rows, cb, umi = [(i % 3 > 0, i * 37 % 1000, "".join("ACGT"[(i >> k) & 3] for k in (0, 2, 4))) for i in range(50)], 10, 6
    data = struct.pack("<4Q", 1, cb, umi, len(rows))
    for ok, index, bases in rows:
        bits = [int(ok)] + [(index >> k) & 1 for k in range(cb)] + [b for x in reversed(bases) for b in ("ACGT".index(x) & 1, "ACGT".index(x) >> 1)]
        data += sum(b << k for k, b in enumerate(bits)).to_bytes(3, "little")
    (tmp_path / "t").write_bytes(data)
    got = spark.read.format("tally_cbub").option("partitions", 4).load(f"{tmp_path}/t").orderBy("rec_no").collect()
    assert [tuple(r) for r in got] == [(i, *r) for i, r in enumerate(rows)]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("B", 1, 3), ("A", 2, 1), ("A", 1, 5)], "barcode string, feature_index int, umis long")
    sinks.write_matrix(cells, 2, str(tmp_path))
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/matrix").collect()]
    assert sorted(lines) == ["1 1 5", "1 2 3", "2 1 1"] and sinks.ready(str(tmp_path))
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/header").collect()] == ["%%MatrixMarket matrix coordinate integer general", "%", "2 2 3"]
    hits = spark.createDataFrame([(5, 2), (1, None), (9, 7)], "rec_no long, probe_index int")
    sinks.write_sidecar(hits, 8, f"{tmp_path}/side")
    assert (tmp_path / "side").read_bytes() == (12).to_bytes(8, "little") + bytes([8, 0, 2, 7])
    sinks.histogram_html(spark.createDataFrame([(1, 5), (7, 2)], "value int, frequency long"), f"{tmp_path}/p.html", "t")
    assert "Plotly" in (tmp_path / "p.html").read_text()


def test_demux_program_keeps_every_read(spark, tmp_path):
    seqs = ["GG" + p + "T" * 4 for p in ("ACGTACGT", "AAAACCCC", "TTTTTTTT")] * 4
    sets = [{"sample": "s", "lane": "0", "r1": write_fastq(tmp_path / "SC7_R1_.fastq", seqs), "r2": write_fastq(tmp_path / "SC7_R2_.fastq", seqs)}]
    probes = spark.createDataFrame([("ACGTACGT", "BC001", 1), ("AAAACCCC", "BC002", 2)], "variant string, probe_name string, probe_index int")
    names = spark.createDataFrame([("SC7", "BC001", "liver")], "library_id string, probe_name string, sample string")
    routed = assign.demux_fastq(fastq.read_fastq(spark, sets), probes, names, "SC7", offset=2)
    assert demux.totals(routed).first().asDict() == {"matched": 4, "unspecified": 4, "undetermined": 4, "total": 12}
    sinks.write_samples(routed, f"{tmp_path}/out")
    back = {(g, m): gzip.decompress((tmp_path / f"out/{g}/R{m}.fastq.gz").read_bytes()).decode().splitlines()[::4] for g in ("liver", "unspecified/SC7_BC002", "undetermined/SC7_unk") for m in (1, 2)}
    assert list(back.values()) == [[f"@r{i + 3 * k}" for k in range(4)] for i in (0, 0, 1, 1, 2, 2)]
    sinks.write_samples(routed.limit(0), f"{tmp_path}/none")
    assert spark.range(1).select(demux.library_id(F.lit("/x/SCA/lib_SC12_R1.fastq"))).first()[0] == "SC12"


def test_lines_go_to_their_record_unsorted(spark, tmp_path):
    """read_fastq(): shuffle partitions follow the files' bytes, and no split is sorted before its lines are dealt."""
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@{i}\nACGT\n+\nIIII\n" for i in range(5000)))
    assert fastq.shares(spark, [str(path)], 1000) == -(-path.stat().st_size // 1000) and fastq.shares(spark, [str(path)]) == 4
    df = fastq.read_fastq(spark, [{"sample": "s", "lane": "0", "r1": str(path)}], strict=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Sort" not in plan[plan.index("REPARTITION_BY_NUM") :].split("Window")[0]
    assert [(r["read_id"], r["r1"]["header"]) for r in df.orderBy("read_id").collect()] == [(i, f"@{i}") for i in range(5000)]


def test_sidecar_by_ranges(spark, tmp_path):
    """marks_of(): places and probes of byte ranges, the head of 9 bytes left out."""
    (tmp_path / "p.bin").write_bytes(bytes(9) + bytes(range(40)))
    spans = spark.createDataFrame([(a, min(a + 7, 49)) for a in range(0, 49, 7)], "first long, end long")
    rows = spans.mapInArrow(roundtrips.marks_of(str(tmp_path / "p.bin")), "place long, probe int").collect()
    assert sorted(map(tuple, rows)) == [(i + 1, i) for i in range(40)]
