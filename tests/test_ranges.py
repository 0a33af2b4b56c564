"""Sources that are read by byte ranges: every record once, whatever the split, and no shuffle."""

import gzip
import random
import struct
import zlib

import pytest

from tallyseq.sources import alignments, fastq, files, stores
from tests.test_sources_sinks import write_fastq


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def block(data):
    """A gzip member that tells its size."""
    z = zlib.compressobj(wbits=-15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_bytes(records, size):
    """A BAM file with blocks of ``size`` bytes of content and an empty one at the end."""
    body = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + (struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)) * 2
    for name, flag, mapq, seq, tags in records:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        aux = b"".join(k.encode() + (b"i" + struct.pack("<i", v) if isinstance(v, int) else b"Z" + v.encode() + b"\0") for k, v in tags.items())
        r = struct.pack("<iiBBHHHiiii", 0, 0, len(name) + 1, mapq, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + b"\xff" * len(seq) + aux
        body += struct.pack("<i", len(r)) + r
    return b"".join(block(body[at : at + size]) for at in range(0, len(body), size)) + block(b"")


def tag_stream(rows, cb=10, umi=6):
    data = struct.pack("<4Q", 1, cb, umi, len(rows))
    for ok, index, bases in rows:
        bits = [int(ok)] + [(index >> k) & 1 for k in range(cb)] + [b for x in reversed(bases) for b in ("ACGT".index(x) & 1, "ACGT".index(x) >> 1)]
        data += sum(b << k for k, b in enumerate(bits)).to_bytes(3, "little")
    return data


def invented(n, seed=1):
    """Records of different lengths; some hold what looks like the head of another record."""
    rng = random.Random(seed)
    bait = struct.pack("<iiiBBHHHiiii", 60, 0, 0, 3, 9, 0, 1, 0, 4, -1, -1, 0).hex()
    return [(f"q{i}", rng.choice([0, 16]), rng.randint(0, 60), "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40))), {"CB": f"c{i % 3}", "UB": "A" * (i % 30), "GX": bait if i % 5 == 0 else "g"}) for i in range(n)]


@pytest.mark.parametrize("size", [40, 300, 5000])
def test_every_split_of_a_bam_file_counts_each_record_once(tmp_path, size):
    """Over all split points: what begins before the point and what begins after make up the file."""
    records = invented(25)
    data = bam_bytes(records, size)
    path = tmp_path / "x.bam"
    path.write_bytes(data)
    whole = alignments.counted(str(path), 0, len(data), None)
    assert whole[2] == 25 and whole[1] == (len(data), 0)
    for point in range(1, len(data), 1 if size > 40 else 7):
        a, b = alignments.counted(str(path), 0, point, None), alignments.counted(str(path), point, len(data), None)
        assert a[2] + b[2] == 25, point
        assert not b[2] or b[0] == a[1], point


def test_partitions_of_a_bam_file(spark, tmp_path):
    records = invented(400, 2)
    (tmp_path / "x.bam").write_bytes(bam_bytes(records, 500))
    alignments.register(spark)
    whole = spark.read.format("tally_bam").load(f"{tmp_path}/x.bam").orderBy("rec_no").collect()
    assert [(r["rec_no"], r["qname"], r["seq"]) for r in whole] == [(i, r[0], r[3]) for i, r in enumerate(records)]
    counts = []
    for split in (300, 3000, 1 << 20):
        df = alignments.read_bam(spark, f"{tmp_path}/x.bam", split=split)
        assert df.orderBy("rec_no").collect() == whole and "Exchange" not in plan_of(df)
        counts.append(df.rdd.getNumPartitions())
    assert counts[0] > counts[1] > counts[2] == 1
    assert [r["rec_no"] for r in alignments.read_bam(spark, f"{tmp_path}/x.bam", max_records=123, split=2000).orderBy("rec_no").collect()] == list(range(123))


def test_a_wrong_guess_is_put_right(spark, tmp_path, monkeypatch):
    """Where a range took another place for its first record, it is counted again from where the one before ends."""
    (tmp_path / "x.bam").write_bytes(bam_bytes(invented(60), 200))
    path, real = f"{tmp_path}/x.bam", alignments.counted
    right = alignments.bam_index(spark, path, 1500)
    ask = lambda row: real(path, row[0], row[1], None if row[2] is None else row[2:])

    def wrong(path_):
        def work(row):
            start, end, n = ask(row)
            if row[0] and row[2] is None and n > 1:  # the first record passed over
                with stores.opened(path_) as f:
                    content = alignments.Content(f, start[0])
                    content.take(start[1])
                    content.record()
                    start, n = content.place(), n - 1
            return row[0], *start, *end, n

        return work

    monkeypatch.setattr(alignments, "_count", wrong)
    assert alignments.bam_index(spark, path, 1500) == right and sum(n for *_, n in right) == 60


def test_gzip_members_without_sizes_are_one_partition(spark, tmp_path):
    plain = gzip.decompress(bam_bytes(invented(30), 400))
    (tmp_path / "x.bam").write_bytes(b"".join(gzip.compress(plain[i : i + 700]) for i in range(0, len(plain), 700)))
    df = alignments.read_bam(spark, f"{tmp_path}/x.bam", split=100)
    assert df.count() == 30 and df.rdd.getNumPartitions() == 1
    (tmp_path / "cut.bam").write_bytes(bam_bytes(invented(30), 400)[:-80])
    with pytest.raises(Exception, match="cut off"):
        alignments.read_bam(spark, f"{tmp_path}/cut.bam").collect()


def test_tag_stream_beside_alignments(spark, tmp_path):
    records = invented(90)
    tags = [(i % 3 > 0, i * 37 % 1000, "".join("ACGT"[(i >> k) & 3] for k in (0, 2, 4))) for i in range(90)]
    (tmp_path / "x.bam").write_bytes(bam_bytes(records, 300))
    (tmp_path / "t").write_bytes(tag_stream(tags))
    df = alignments.read_bam(spark, f"{tmp_path}/x.bam", split=700, cbub=f"{tmp_path}/t")
    assert "Exchange" not in plan_of(df) and df.rdd.getNumPartitions() > 3
    assert [(r["qname"], r["has_tags"], r["cb_idx"], r["umi"]) for r in df.orderBy("rec_no").collect()] == [(r[0], *t) for r, t in zip(records, tags, strict=True)]
    for n, said in ((89, "ends before"), (91, "left over")):
        (tmp_path / "u").write_bytes(tag_stream((tags * 2)[:n]))
        with pytest.raises(ValueError, match=said):
            alignments.read_bam(spark, f"{tmp_path}/x.bam", cbub=f"{tmp_path}/u")
    assert alignments.read_bam(spark, f"{tmp_path}/x.bam", cbub=f"{tmp_path}/t", max_records=40).count() == 40


def test_fastq_of_many_splits(spark, tmp_path):
    """Mates of different lengths, a file that ends within a record, a path with a space; the same as the reader through Spark."""
    r1, r2 = ["ACGT"[i % 4] * (i % 7 + 1) for i in range(50)], ["ACGT"[i % 4] * (i % 11 + 3) for i in range(47)]
    sets = [{"sample": "s", "lane": "0", "r1": write_fastq(tmp_path / "a b_R1_.fastq", r1), "r2": write_fastq(tmp_path / "a b_R2_.fastq", r2, cut=3)}]
    want = fastq.read_fastq(spark, sets).orderBy("read_id").collect()
    for split in (21, 50, 333, 1 << 20):
        df = fastq.read_sets(spark, sets, split=split)
        assert df.orderBy("read_id").collect() == want and "Exchange" not in plan_of(df)
        assert df.rdd.getNumPartitions() > 1 or split == 1 << 20
    assert [r["read_id"] for r in fastq.read_sets(spark, sets, max_reads=9, split=60).orderBy("read_id").collect()] == list(range(9))
    slim = fastq.read_any(spark, sets, slim=True).orderBy("read_id").collect()
    assert [r["r1"]["seq"] for r in slim] == r1[:47] and slim[0]["r1"]["header"] is None
    for split in (60, 1 << 20):
        with pytest.raises(ValueError, match="differ in length"):
            fastq.read_sets(spark, sets, strict=True, split=split)


def test_no_read_is_lost(spark, tmp_path):
    """Folders of one name, and a name that comes back."""
    made = {}
    for folder in ("p/x", "q/x"):
        (tmp_path / folder).mkdir(parents=True)
        made[folder] = [write_fastq(tmp_path / folder / f"l_{m}_.fastq", ["ACGT"] * 5) for m in ("R1", "R2")]
    sets = files.by_directory(str(tmp_path))
    assert [(s["sample"], s["lane"]) for s in sets] == [("x", "0"), ("x", "1")] and all(s["bytes"] > 0 for s in sets)
    names = files.by_name([made["p/x"][0], "b_R1_", made["q/x"][0]], [made["p/x"][1], "b_R2_", made["q/x"][1]], [])
    assert [(s["sample"], s["lane"]) for s in names] == [("l", "0"), ("l", "1"), ("b", "0")]
    for read in (fastq.read_fastq, fastq.read_sets):
        assert read(spark, sets).select("sample", "lane", "read_id").distinct().count() == 10
        with pytest.raises(ValueError, match="several file sets"):
            read(spark, [s | {"lane": "0"} for s in sets])
