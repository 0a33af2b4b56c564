import gzip
import json

import pytest
from pyspark.sql import functions as F

from tallyseq.operators import demux, match
from tallyseq.plans import programs
from tallyseq.sinks import files as sinks
from tallyseq.sources import fastq, tables
from tests.test_ranges import bam_bytes, tag_stream
from tests.test_sources_sinks import RECORDS, bam, write_fastq

CELLS = ("ACGTACGTACGTACGT", "TTTTCCCCAAAAGGGG")
GUIDE = "ACGTTGCAATCGGATCCTAG"


def inputs(tmp_path):
    """Two cells, one guide; the second cell's reads differ from it in the last base."""
    (tmp_path / "wl.txt").write_text("\n".join(CELLS) + "\n")
    (tmp_path / "f.csv").write_text(f"name,sequence,pattern\nFeat1,{GUIDE},NNNN(BC)\nFeat2,{GUIDE[::-1]},NNNN(BC)\n")
    umis = ["".join("ACGT"[(i * 7 >> 2 * k) & 3] * 2 for k in range(6)) for i in range(8)]
    r1 = [c + u for c in CELLS for u in umis for _ in range(3)]
    r2 = ["TTTT" + (GUIDE if c == CELLS[0] else GUIDE[:-1] + "A") + "CC" for c in CELLS for _ in umis for _ in range(3)]
    (tmp_path / "in").mkdir()
    write_fastq(tmp_path / "in" / "s_R1_.fastq.gz", r1)
    write_fastq(tmp_path / "in" / "s_R2_.fastq.gz", r2)
    return len(set(umis))


def test_assign_program_writes_all_files(spark, tmp_path):
    molecules = inputs(tmp_path)
    (tmp_path / "keep.txt").write_text(CELLS[1] + "\n")
    run = lambda **more: programs.assign_barcodes(spark, f"{tmp_path}/wl.txt", f"{tmp_path}/f.csv", f"{tmp_path}/out", directory=f"{tmp_path}/in", filtered=f"{tmp_path}/keep.txt", **more)
    (folder,) = run()
    matrix = (tmp_path / "out" / "in" / "matrix.mtx").read_text().splitlines()
    assert matrix == ["%%MatrixMarket matrix coordinate integer general", "%", "2 2 2", f"1 1 {molecules}", f"1 2 {molecules}"]
    assert (tmp_path / "out/in/barcodes.txt").read_text().split() == sorted(CELLS)
    assert (tmp_path / "out/in/features.txt").read_text().split() == ["Feat1", "Feat2"]
    rows = [x.split() for x in (tmp_path / "out/in/feature_sequences.txt").read_text().splitlines()[1:]]
    assert rows == [["1", GUIDE, "0", "24", "4", "Feat1"], ["1", GUIDE[:-1] + "a", "1", "24", "4", "Feat1"]]
    stats = dict(x.rsplit(" ", 1) for x in (tmp_path / "out/in/stats.txt").read_text().splitlines())
    assert len(stats) == 8 and stats["Total feature counts"] == "48" and stats["Total barcodes"] == "2" and stats["Percentage reads assigned to barcode"] == "100.0000"
    assert (tmp_path / "out/in/filtered/barcodes.txt").read_text().split() == [CELLS[1]] and "Total excluded barcodes 1" in (tmp_path / "out/in/filtered/stats.txt").read_text()
    assert (tmp_path / "out/in/deduped_counts_histograms.txt").read_text().splitlines()[1:] == [f"Feat1\t{molecules}\t2"]
    assert json.loads((tmp_path / "out/in/Feature_coexpression_heatmap.json").read_text())["matrix"] == [[2]]
    assert run(keep_existing=True) == [] and folder.endswith("/in")


def test_all_samples_in_the_same_jobs(spark, tmp_path):
    """Three samples at once: the files of three single runs, in as many jobs as one; one sample has no hit at all, barcodes are rescued by the counts of their own sample."""
    (tmp_path / "wl.txt").write_text("\n".join([*CELLS, "ACGTACGTACGTACGA"]) + "\n")
    (tmp_path / "f.csv").write_text(f"name,sequence,pattern\nFeat1,{GUIDE},NNNN(BC)\nFeat2,{GUIDE[::-1]},NNNN(BC)\n")
    (tmp_path / "keep.txt").write_text(CELLS[1] + "\n")
    umis = ["".join("ACGT"[(i * 7 >> 2 * k) & 3] * 2 for k in range(6)) for i in range(8)]
    close = "ACGTACGTACGTACGC"  # one base from two cells
    for name, cells, guide in (("s1", (CELLS[0],) * 3 + (close,), GUIDE), ("s2", ("ACGTACGTACGTACGA",) * 3 + (close, CELLS[1]), GUIDE[::-1]), ("s3", CELLS, "T" * 20)):
        for lane in (1, 2):
            (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
            r1 = [c + u for c in cells for u in umis[lane:] for _ in range(30)]
            write_fastq(tmp_path / "in" / name / f"x_L{lane}_R1_.fastq", r1)
            write_fastq(tmp_path / "in" / name / f"x_L{lane}_R2_.fastq", ["TTTT" + guide + "CC"] * len(r1))
    jobs = {}

    def run(where, out):
        spark.sparkContext.setJobGroup(out, out)
        made = programs.assign_barcodes(spark, f"{tmp_path}/wl.txt", f"{tmp_path}/f.csv", f"{tmp_path}/{out}", directory=str(where), filtered=f"{tmp_path}/keep.txt", min_counts=0, min_posterior=0.7)
        jobs[out] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(out))
        return made

    assert sorted(run(tmp_path / "in", "all")) == [f"{tmp_path}/all/{s}" for s in ("s1", "s2", "s3")]
    for s in ("s1", "s2", "s3"):
        run(tmp_path / "in" / s, f"one{s}")
        files = sorted(p.relative_to(tmp_path / f"one{s}" / s) for p in (tmp_path / f"one{s}" / s).rglob("*") if p.is_file() and not p.name.endswith(".crc"))
        assert len(files) >= 14 and all((tmp_path / f"one{s}" / s / p).read_bytes() == (tmp_path / "all" / s / p).read_bytes() for p in files)
        assert files == sorted(p.relative_to(tmp_path / "all" / s) for p in (tmp_path / "all" / s).rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert jobs["all"] <= 1.1 * max(jobs["ones1"], jobs["ones2"])
    assert (tmp_path / "all/s1/barcodes.txt").read_text().split() == [CELLS[0]] and (tmp_path / "all/s2/barcodes.txt").read_text().split() == ["ACGTACGTACGTACGA", CELLS[1]]
    assert (tmp_path / "all/s3/matrix.mtx").read_text().splitlines()[2:] == ["2 0 0"]


def test_options_that_exclude_each_other(spark, tmp_path):
    with pytest.raises(ValueError, match="must differ"):
        programs.file_sets("x", patterns=("_R1_", "_R1_", "_R3_"))
    with pytest.raises(ValueError, match="exclude"):
        programs.file_sets("x", r1="a", r2="b")
    with pytest.raises(ValueError, match="needed"):
        programs.file_sets()
    with pytest.raises(ValueError, match="stringency"):
        programs.checked(1001, 1, 1, 0.9, 0)
    with pytest.raises(ValueError, match="go together"):
        programs.demux_bam(spark, "x.bam", "p", "o", cbub="t")
    features = lambda *offsets: spark.createDataFrame([(i, o) for i, o in enumerate(offsets)], "feature_index int, pattern_offset int")
    with pytest.raises(ValueError, match="exclude each other"):
        match.constant_offset(features(1), 3, True)
    with pytest.raises(ValueError, match="several offsets"):
        match.constant_offset(features(*[4] * 19, 5))
    assert match.constant_offset(features(*[4] * 20, 5)) == 4 and match.constant_offset(features(-1)) is None
    assert match.constant_offset(features(4, 5), 5) == 5 and match.constant_offset(features(4, 5), individual=True) == match.OWN


def test_demux_programs(spark, tmp_path):
    (tmp_path / "probes").write_text("ACGTACGT ACGTACGT BC001\nTTTTACGT ACGTACGT BC001\nAAAACCCC AAAACCCC BC002\n")
    (tmp_path / "map").write_text("lib probe sample\nSC7 BC001 liver\n")
    seqs = ["GG" + p + "T" * 4 for p in ("ACGTACGT", "AAAACCCC", "TTTTTTTT")] * 4
    r1, r2 = write_fastq(tmp_path / "SC7_R1_.fastq.gz", seqs), write_fastq(tmp_path / "SC7_R2_.fastq.gz", seqs)
    totals = programs.demux_fastq(spark, f"{tmp_path}/probes", f"{tmp_path}/map", f"{tmp_path}/out", r1=r1, r2=r2, offset=2)
    assert totals.first().asDict() == {"library_id": "SC7", "matched": 4, "unspecified": 4, "undetermined": 4, "total": 12}
    ends = [gzip.decompress((tmp_path / f"out/samples/liver/R{m}.fastq.gz").read_bytes()).decode().splitlines() for m in (1, 2)]
    assert ends[0] == ends[1] and [x for x in ends[0] if x.startswith("@")] == ["@r0", "@r3", "@r6", "@r9"] and len(ends[0]) == 16
    bam(tmp_path / "x.bam", RECORDS)
    programs.demux_bam(spark, f"{tmp_path}/x.bam", f"{tmp_path}/probes", f"{tmp_path}/bam", offset=2, read_map=True)
    assert (tmp_path / "bam/matrix.mtx").read_text().splitlines()[2:] == ["2 1 1", "1 1 2"]
    assert (tmp_path / "bam/features.tsv").read_text().split() == ["BC001", "BC002"] and (tmp_path / "bam/barcodes.tsv").read_text().split() == ["c1"]
    assert (tmp_path / "bam/stats.txt").read_text().splitlines() == ["Total_records\t4", "Usable_records\t2", "BC_ID\tTotal_reads", "BC001\t2", "BC002\t0"]
    assert (tmp_path / "bam/read_to_cb_umi_gene.txt").read_text().splitlines() == ["q1\tc1\tAC\tg2"]  # q5 has no probe
    programs.demux_bam(spark, f"{tmp_path}/x.bam", f"{tmp_path}/probes", f"{tmp_path}/bin", offset=2, binary=True)
    assert (tmp_path / "bin/probes.bin").read_bytes() == (14).to_bytes(8, "little") + bytes([2, 1, 1, 1, 0, 0])


def test_demux_bam_with_a_tag_stream(spark, tmp_path):
    """A byte for every record that passes the filters; no tags: no part of the totals; an index beyond the whitelist: in the totals, not counted."""
    (tmp_path / "probes").write_text("ACGTACGT ACGTACGT BC001\nAAAACCCC AAAACCCC BC002\n")
    (tmp_path / "cells").write_text("GGGG\nCCCC\n")
    records = [(f"q{i}", flag, 30, f"GG{p}T", {"GX": g, "NH": 1 + i}) for i, (flag, p, g) in enumerate([(0, "ACGTACGT", "g"), (0, "AAAACCCC", "g"), (1024, "ACGTACGT", "g"), (0, "AAAACCCC", "g"), (0, "ACGTACGT", "-g"), (0, "TTTTTTTT", "g")])]
    tags = [(True, 1, "ACA"), (False, 0, "AAA"), (True, 1, "AAA"), (True, 9, "AAA"), (True, 2, "AAA"), (True, 2, "AAC")]
    (tmp_path / "x.bam").write_bytes(bam_bytes(records, 60))
    (tmp_path / "tags").write_bytes(tag_stream(tags))
    sam = "@HD\tVN:1.6\n" + "".join(f"{n}\t{f}\tc1\t1\t{m}\t*\t*\t0\t0\t{s}\t*\tGX:Z:{t['GX']}\tNH:i:{t['NH']}\n" for n, f, m, s, t in records)
    (tmp_path / "x.sam").write_text(sam)
    for kind in ("bam", "sam"):
        run = lambda out, **more: programs.demux_bam(spark, f"{tmp_path}/x.{kind}", f"{tmp_path}/probes", f"{tmp_path}/{kind}{out}", offset=2, cbub=f"{tmp_path}/tags", whitelist=f"{tmp_path}/cells", **more)  # noqa: B023, E731
        assert [tuple(r) for r in run("m", read_map=True, nh_debug=True).collect()] == [("GGGG", 1, 1)]
        assert (tmp_path / f"{kind}m/stats.txt").read_text().splitlines() == ["Total_records\t4", "Usable_records\t1", "BC_ID\tTotal_reads", "BC001\t1", "BC002\t0"]
        assert (tmp_path / f"{kind}m/read_to_cb_umi_gene.txt").read_text() == "q0\tGGGG\tACA\tg\n"
        staged = [json.loads(x) for x in (tmp_path / f"{kind}m/nh_staging.jsonl").read_text().splitlines()]
        assert [(x["event"], x["index"], x["qname"], x["meta_nh"], x["sampleIdx"], x["cbIdxPlus1"]) for x in staged] == [("nh_staging", i, *x) for i, x in enumerate([("q0", 1, 1, 1), ("q3", 4, 2, 0), ("q4", 5, 1, 2), ("q5", 6, 0, 2)])]
        assert [json.loads(x) for x in (tmp_path / f"{kind}m/nh_tap.jsonl").read_text().splitlines()] == [{"event": "nh_tap", "qname": "q0", "nh": 1, "sampleIdx": 1, "cbIdxPlus1": 1}]
        run("b", binary=True)
        assert (tmp_path / f"{kind}b/probes.bin").read_bytes() == (14).to_bytes(8, "little") + bytes([2, 1, 0, 2, 1, 0])
        for n, said in ((5, "ends before"), (7, "left over")):
            (tmp_path / "other").write_bytes(tag_stream((tags * 2)[:n]))
            with pytest.raises(ValueError, match=said):
                programs.demux_bam(spark, f"{tmp_path}/x.{kind}", f"{tmp_path}/probes", f"{tmp_path}/e", cbub=f"{tmp_path}/other", whitelist=f"{tmp_path}/cells")


def test_probes_by_map_and_by_join(spark, monkeypatch):
    probes = spark.createDataFrame([("ACGTACGT", "b", 2), ("ACGTACGT", "a", 1), ("CGTACGTT", "c", 3), (None, "n", 4)], "variant string, probe_name string, probe_index int")
    reads = spark.createDataFrame([(1, "GGACGTACGTT"), (2, "GACGTACGTTT"), (3, "TTTTTTTTTTTTT"), (4, None), (5, "GGNCGTACGTTT")], "read_id long, seq string")
    answers = []
    for most in (512, 0):
        monkeypatch.setattr(demux, "MAPPED", most)
        answers.append([[(r["read_id"], r["probe_name"], r["probe_index"]) for r in demux.probe_of(reads, probes, 2, nearby=near).orderBy("read_id").collect()] for near in (False, True)])
    assert answers[0] == answers[1] == [[(1, "a", 1), (2, "c", 3), (3, None, None), (4, None, None), (5, None, None)], [(1, "a", 1), (2, "c", 3), (3, None, None), (4, None, None), (5, "c", 3)]]
    assert demux.probe_of(reads, probes.limit(0), 2).where("probe_index is null").count() == 5


def test_files_are_put_together_on_executors(spark, tmp_path):
    """Text and bytes, over a file that was there before; no parts at all."""
    for n in (3000, 5, 0):
        sinks.write_lines(spark.range(n).select(F.col("id").cast("string").alias("value"), "id").repartition(7), f"{tmp_path}/lines", "id", head="head\n")
        assert (tmp_path / "lines").read_text().splitlines() == ["head", *map(str, range(n))]
        assert [r["value"] for r in spark.read.text(f"{tmp_path}/lines").collect()] == ["head", *map(str, range(n))]
        sinks.write_bytes(spark.range(n).select(F.col("id").cast("string").cast("binary").alias("data"), "id").repartition(5), f"{tmp_path}/bytes", "id", head=b">")
        assert (tmp_path / "bytes").read_bytes() == b">" + b"".join(str(i).encode() for i in range(n))


def test_line_numbers_of_dictionaries(spark, tmp_path):
    (tmp_path / "w").write_text("GGGG\r\nCCCC\n\nAAAA\nGGGG")
    assert [tuple(r) for r in tables.lines(spark, f"{tmp_path}/w").orderBy("line_no").collect()] == [(1, "GGGG"), (2, "CCCC"), (3, ""), (4, "AAAA"), (5, "GGGG")]
    assert {(r["wl_idx"], r["barcode"]) for r in tables.whitelist(spark, f"{tmp_path}/w").collect()} == {(1, "GGGG"), (2, "CCCC"), (3, "AAAA")}


def test_readers_agree(spark, tmp_path):
    """Several gzip members, a file cut off within a record, a path with a space, and equal names in different folders."""
    sets = []
    for i, folder in enumerate(("a b/x", "c+d/x")):
        (tmp_path / folder).mkdir(parents=True)
        r1, r2 = ([f"{b}{'ACGT'[k % 4] * 5}" for k in range(9)] for b in "AC")
        sets.append({"sample": "s", "lane": str(i), "r1": write_fastq(tmp_path / folder / "s_R1_.fastq.gz", r1), "r2": write_fastq(tmp_path / folder / "s_R2_.fastq.gz", r2, cut=i * 9)})
    first = tmp_path / "a b/x/s_R1_.fastq.gz"
    first.write_bytes(b"".join(gzip.compress(x) for x in (gzip.decompress(first.read_bytes())[:50], gzip.decompress(first.read_bytes())[50:])))
    rows = lambda df: df.orderBy("lane", "read_id").collect()
    both = [rows(f(spark, sets)) for f in (fastq.read_fastq, fastq.read_sets)]
    assert both[0] == both[1] and [r["lane"] for r in both[0]] == ["0"] * 9 + ["1"] * 8
    assert rows(fastq.read_sets(spark, sets, max_reads=2)) == rows(fastq.read_fastq(spark, sets, max_reads=2))
    with pytest.raises(Exception, match="differ in length"):
        fastq.read_sets(spark, sets, strict=True).collect()
    assert not sinks.exists(spark, f"{tmp_path}/none")
