"""Feature search: the expression of a row, the joins and a plain version give the same."""

import random
from functools import cache

import pytest

from tallyseq.functions import dna
from tallyseq.operators import match, search
from tallyseq.plans import programs
from tallyseq.streaming import matching
from tests.test_sources_sinks import write_fastq


def spelled(text, budget):
    if set(text) - set("ACGTN") or text.count("N") >= budget:
        return []
    out = [""]
    for c in text:
        out = [x + y for x in out for y in ("ACGT" if c == "N" else c)]
    return out


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def single(hits):
    """Least (hamming, priority, position, window, feature), None if different features share the least distance."""
    best = min(hits, default=None)
    return None if best is None or {h[4] for h in hits if h[0] == best[0]} != {best[4]} else best


class Plain:
    def __init__(self, features, m, budget):
        self.features, self.m, self.budget = features, m, budget

    def at(self, seq, place, priority=0, own=False):
        hits = []
        for n in {len(f[1]) for f in self.features}:
            raw = seq[place : place + n] if place >= 0 else ""
            for w in spelled(raw, self.budget) if len(raw) == n else []:
                near = [(apart(w, s), i) for i, s, o in self.features if len(s) == n and (not own or o == place - own[0])]
                near = [x for x in near if x[0] <= self.m]
                if near and len({i for h, i in near if h == min(near)[0]}) == 1:
                    hits.append((min(near)[0], priority, place, w, min(near)[1]))
        return hits

    def anchored(self, seq, anchor, shift):
        if anchor is not None:
            return single(self.at(seq, anchor + shift))
        return single([h for o in sorted({f[2] for f in self.features if f[2] is not None}) for h in self.at(seq, o + shift, own=[shift])])

    def everywhere(self, seq):
        """(hamming, feature or None, position, window)."""
        hits = {(apart(w[p : p + len(s)], s), p % 4, i, p, w[p : p + len(s)]) for w in spelled(seq, self.budget) for i, s, _ in self.features for p in range(len(w) - len(s) + 1)}
        hits = {h for h in hits if h[0] <= self.m}
        if not hits:
            return None
        best = min(hits)
        return best[0], best[2] if best[0] == 0 or sum(h[0] == best[0] for h in hits) == 1 else None, best[3], best[4]

    def cascade(self, seq, anchor):
        at, before, behind = (self.anchored(seq, anchor, s) for s in (0, -1, 1))
        for hit in (at, before, behind):
            if hit and hit[0] == 0:
                return 0, hit[4], hit[2], hit[3]
        best = at
        for other in (before, behind):
            best = other if best and other and other[0] < best[0] else best
        wide = self.everywhere(seq)
        if best is None or (wide and wide[0] < best[0]):
            return wide
        return best[0], best[4], best[2], best[3]

    def in_window(self, seq, anchor, reach):
        shifts = [0] + [s for k in range(1, reach + 1) for s in (k, -k)]
        hits = [h for p, s in enumerate(shifts) for h in self.at(seq, anchor + s, p)]
        if exact := [(h[1], h[4], h[2], h[3]) for h in hits if h[0] == 0]:
            _, feature, position, window = min(exact)
            return 0, feature, position, window
        best = single(hits)
        return best and (best[0], best[4], best[2], best[3])


@cache
def features():
    """Two lengths, one over 31 bases; two features that differ in one base; anchors 2, 3, 5 and none."""
    rng = random.Random(7)
    made = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (8, 8, 8, 36, 36)]
    made.append(made[0][:-1] + ("A" if made[0][-1] != "A" else "C"))
    return [(i + 1, s, a) for i, (s, a) in enumerate(zip(made, (2, 3, None, 5, 2, 2), strict=True))]


def invented(n, seed):
    rng, letters = random.Random(seed), lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    out = [None, "", "A", "NNNN", "ACGTX" * 9]
    for _ in range(n):
        s = list(rng.choice(features())[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        out.append(letters(rng.randint(0, 6)) + "".join(s) + letters(rng.randint(0, 5)) + rng.choice(["", "", rng.choice(features())[1]]))
    return list(enumerate(out))


@pytest.mark.parametrize(("m", "budget"), [(0, 1), (1, 2), (2, 3)])
def test_search_against_plain_and_joins(spark, monkeypatch, m, budget):
    rows = invented(80, m)
    reads = spark.createDataFrame(rows, "read_id long, seq string").repartition(2)
    names = spark.createDataFrame([(i, s, -1 if a is None else a) for i, s, a in features()], "feature_index int, sequence string, pattern_offset int")
    plain = Plain(features(), m, budget)
    asked = {
        "fuzzy": (lambda: match.fuzzy_at(reads, names, 3, m, budget), lambda s: (h := plain.anchored(s, 3, 0)) and (h[0], h[4], h[2], h[3])),
        "window": (lambda: match.in_window(reads, names, 1, 2, m, budget), lambda s: plain.in_window(s, 1, 2)),
        "everywhere": (lambda: match.exhaustive(reads, names, m, budget), plain.everywhere),
        "cascade": (lambda: match.cascade(reads, names, 3, m, budget), lambda s: plain.cascade(s, 3)),
        "at zero": (lambda: match.cascade(reads, names, 0, m, budget), lambda s: plain.cascade(s, 0)),
        "own anchors": (lambda: match.cascade(reads, names, match.OWN, m, budget), lambda s: plain.cascade(s, None)),
    }
    for name, (run, answer) in asked.items():
        want = {i: a for i, s in rows if s is not None and (a := answer(s)) and a[1] is not None}
        monkeypatch.undo()
        got = {r["read_id"]: (r["hamming"], r["feature_index"], r["match_position"], r["matched_sequence"]) for r in run().collect()}
        assert got == want, (name, [(i, rows[i], got.get(i), want.get(i)) for i in sorted(got.keys() | want.keys()) if got.get(i) != want.get(i)][:3])
        if m == 1 and name in ("everywhere", "window", "own anchors"):
            monkeypatch.setattr(search, "MOST_FEATURES", -1)
            assert {r["read_id"]: (r["hamming"], r["feature_index"], r["match_position"], r["matched_sequence"]) for r in run().collect()} == want, name


def test_exact_search_both_ways(spark, monkeypatch):
    rows = invented(80, 3)
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    names = spark.createDataFrame(features(), "feature_index long, sequence string, pattern_offset int")
    want = {i: min(f) for i, s in rows if s and (f := [j for j, x, _ in features() if s[3 : 3 + len(x)] == x])}
    for most in (20_000, -1):
        monkeypatch.setattr(search, "MOST_FEATURES", most)
        found = match.exact_at(reads, names, 3)
        assert {r["read_id"]: r["feature_index"] for r in found.collect()} == want and dict(found.dtypes)["feature_index"] == "bigint"


def test_packed_words_count_differences(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ACGT") for _ in range(41)), "".join(rng.choice("ACGT") for _ in range(41))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(search.distance(search.words(df["a"], 41), search.words(df["b"], 41))).collect()] == [apart(a, b) for a, b in rows]
    assert [r[0] for r in df.select(dna.hamming(df["a"], df["b"])).collect()] == [apart(a, b) for a, b in rows]


def test_one_guide_in_most_reads_and_no_shuffle_of_large_inputs(spark, monkeypatch):
    """Reads stay in their partitions: a guide that nine of ten reads hold is no hot key."""
    guide = features()[0][1]
    reads = spark.range(5000).selectExpr("id as read_id", f"if(id % 10 = 0, 'ACGTTTTTTTTTT', concat('TTT', '{guide}')) as seq")
    names = spark.createDataFrame(features(), "feature_index int, sequence string, pattern_offset int")
    monkeypatch.setattr(search, "SPLIT", 0)
    found = match.annotated(reads, names, 3, 0)
    assert found.where("feature_index = 1").count() == 4500 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_search_over_a_stream(spark, tmp_path):
    """One mismatch and N: the stream's rows are those of the batch."""
    guides = [(i, s, a) for i, s, a in features()]
    names = spark.createDataFrame(guides, "feature_index int, sequence string, pattern_offset int")
    cells = spark.createDataFrame([("ACGT",), ("CCCC",)], "barcode string")
    rows = [(i, "ACGT" if i % 3 else "GGGG", "AC", s) for i, s in invented(120, 9)]
    reads = spark.createDataFrame(rows, "read_id long, barcode string, umi string, seq string")
    reads.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = "read_id long, barcode string, umi string, seq string"
    for k, offset in enumerate((3, None, match.OWN)):
        stream = matching.assigned(matching.read_stream(spark, f"{tmp_path}/in", schema, 1), cells, names, offset, m=1, max_n=2)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out{k}").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
        query.awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{k}").select("barcode", "umi", "feature_index", "read_id").collect()}
        batch = match.cascade(reads, names, offset, 1, 2).join(reads.where("barcode = 'ACGT'").select("read_id"), "read_id")
        assert got == {("ACGT", "AC", r["feature_index"], r["read_id"]) for r in batch.collect()} and got


def test_program_without_patterns_searches_everywhere(spark, tmp_path):
    """One read whose guide has its last base changed, a list without a pattern column."""
    (tmp_path / "whitelist.txt").write_text("ACGTACGTACGTACGT\n")
    (tmp_path / "features.csv").write_text("id,name,sequence,feature_type\nfeat1,Feat1,ACGTACGTACGTACGTACGT,CRISPR Guide Capture\n")
    (tmp_path / "in").mkdir()
    write_fastq(tmp_path / "in" / "sample_R1_001.fastq", ["ACGTACGTACGTACGT" + "A" * 12])
    write_fastq(tmp_path / "in" / "sample_R2_001.fastq", ["ACGTACGTACGTACGTACGA"])
    (folder,) = programs.assign_barcodes(spark, f"{tmp_path}/whitelist.txt", f"{tmp_path}/features.csv", f"{tmp_path}/out", directory=f"{tmp_path}/in", m=1, max_n_feature=1, max_n_barcode=1, stringency=1, min_counts=0)
    assert (tmp_path / "out/in/matrix.mtx").read_text().splitlines()[2:] == ["1 1 1", "1 1 1"]
    (line,) = (tmp_path / "out/in/feature_sequences.txt").read_text().splitlines()[1:]
    assert line.split() == ["1", "ACGTACGTACGTACGTACGa", "1", "1", "0", "Feat1"]


def test_program_with_an_anchor_for_each_feature(spark, tmp_path):
    """Guide 2 in front, guide 1 behind: each counts at its own place; with one anchor for all only what stands there."""
    one, two = "ACGTTGCAATCGGATCCTAG", "TTGACCATGGCTAACGTCAA"
    (tmp_path / "w").write_text("ACGTACGTACGTACGT\n")
    (tmp_path / "f.csv").write_text(f"name,sequence,pattern\nOne,{one},NNNN(BC)\nTwo,{two},NN(BC)\n")
    (tmp_path / "in").mkdir()
    umis = ["ACGTACGTACGT", "CCCCGGGGTTTT", "GATTACAGATTA"]
    write_fastq(tmp_path / "in" / "s_R1_.fastq", ["ACGTACGTACGTACGT" + u for u in umis])
    write_fastq(tmp_path / "in" / "s_R2_.fastq", ["GGGG" + one + "C", "GG" + two + "CCC", "GG" + two[:-1] + "C" + "CCC"])
    programs.assign_barcodes(spark, f"{tmp_path}/w", f"{tmp_path}/f.csv", f"{tmp_path}/out", directory=f"{tmp_path}/in", individual_offsets=True, min_counts=0)
    assert (tmp_path / "out/in/matrix.mtx").read_text().splitlines()[2:] == ["2 1 2", "1 1 1", "2 1 2"]
    with pytest.raises(ValueError, match="several offsets"):
        programs.assign_barcodes(spark, f"{tmp_path}/w", f"{tmp_path}/f.csv", f"{tmp_path}/out", directory=f"{tmp_path}/in")
