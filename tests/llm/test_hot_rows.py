"""Packing where one doc_id, or null, holds most rows; line hashes of ASCII and other lines side by side."""

import numpy as np
import pytest

from tallyseq.llm import line_dedup, packing


@pytest.mark.parametrize("run", [7, 10_000])
def test_packing_with_most_rows_under_null_or_one_id(table, monkeypatch, run):
    monkeypatch.setattr(packing, "RUN", run)
    docs = [(None, "a b c")] * 300 + [(None, "a b c d e")] * 41 + [(5, "x y z")] * 200 + [(5, None)] * 9 + [(i, "w " * (i % 9)) for i in range(6, 60)]
    rows = packing.pack(table(docs), buckets=2, longest=8, budget=40, per_shard=20).collect()
    assert len(rows) == len(docs)
    count = lambda i, n: sum(r["doc_id"] == i and r["n_tokens"] == n for r in rows)
    assert [count(None, 3), count(None, 5), count(5, 3), count(5, 0)] == [300, 41, 200, 9]
    batches = {}
    for r in rows:
        if r["bucket_len"]:
            batches.setdefault((r["bucket_len"], int(r["batch_id"].split("-")[1])), []).append(r["slot"])
    for (size, n), slots in batches.items():
        last = max(m for s, m in batches if s == size)
        assert sorted(slots) == list(range(40 // size if n < last else len(slots)))


def test_runs_of_ascii_hash_alike_in_any_line():
    lines = [b"abcdefghij", "abcdefghijé".encode(), "日本 abcdefgh 日本 abcdefgh".encode(), b"abc", b"", "é".encode(), b"abcdefgh" * 10]
    sets = line_dedup.sets_of(lines)
    assert [len(s) for s in sets] == [len({t[i : i + 8] for i in range(max(1, len(t) - 7))}) for t in (x.decode() for x in lines)]
    assert len(np.intersect1d(sets[0], sets[1])) == 3 and len(np.intersect1d(sets[0], sets[2])) == 1 and not len(np.intersect1d(sets[3], sets[0]))


def test_signatures_do_not_depend_on_the_lines_beside(monkeypatch):
    rng = np.random.default_rng(4)
    lines = ["".join(rng.choice(list("abc é日"[: 4 + 2 * (i % 2)]), int(rng.integers(0, 60)))).encode() for i in range(80)]
    alone = np.concatenate([line_dedup.signatures([x], 12) for x in lines])
    for size in (1, 100, 50_000):
        monkeypatch.setattr(line_dedup, "CHUNK", size)
        assert (line_dedup.signatures(lines, 12) == alone).all()
        assert all((a == b).all() for a, b in zip(line_dedup.sets_of(lines), [line_dedup.sets_of([x])[0] for x in lines], strict=True))
    assert line_dedup.signatures([], 12).shape == (0, 12) and line_dedup.sets_of([]) == []
