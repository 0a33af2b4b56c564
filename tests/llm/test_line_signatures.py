"""Signatures of lines: both ends of each permutation, and runs of characters below 256 as words."""

import random

import numpy as np
import pytest

from tallyseq.llm import line_dedup, neardup
from tallyseq.llm.common import mix64


def test_both_ends_of_a_permutation():
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdéß語", k=n)).encode() for n in (3, 8, 9, 30, 400)]
    sig = line_dedup.signatures(lines, 12)
    assert (sig[:2, :6] == sig[:2, 6:]).all()  # one run
    assert (sig[2:, :6] < sig[2:, 6:]).all()
    assert line_dedup.signatures(lines, 11).shape == (5, 11)


def test_similar_lines_agree_as_often_as_they_are_similar():
    rng = random.Random(5)
    pairs = [["".join(rng.choices("abcdefghij", k=107)) for _ in range(2)] for _ in range(200)]
    near = [(x, x[:57] + y[57:]) for x, y in pairs]  # 50 of 150 runs
    a, b = (line_dedup.signatures([p[k].encode() for p in near], 104) for k in (0, 1))
    same = (a == b).mean(0)
    assert abs(same[:52].mean() - 1 / 3) < 0.03 and abs(same[52:].mean() - 1 / 3) < 0.03


def test_runs_of_latin_characters_are_words():
    line = "Öl für die Küche".lower()
    text = line.encode("latin-1")
    want = mix64(np.array([int.from_bytes(text[k : k + 8], "little") for k in range(len(text) - 7)], np.uint64))
    h, many = line_dedup.shingle_hashes([line.encode()])
    assert many.tolist() == [len(want)] and (h == want).all()
    beside, _ = line_dedup.shingle_hashes([f"{line}語".encode()])
    assert (beside[:-1] == want).all() and beside[-1] not in want


def test_only_bands_with_company_leave_a_block(table, monkeypatch, spark):
    """Two near lines and one that has nothing in common with them: the rows that meet by band are those of bands that both have."""
    keys, made = neardup.band_keys, spark.sparkContext.accumulator(0)

    def counted(bands, rows):
        def run(batches):
            for b in keys(bands, rows)(batches):
                made.add(b.num_rows)
                yield b

        return run

    monkeypatch.setattr(neardup, "band_keys", counted)
    monkeypatch.setattr(neardup, "key_lists", lambda *_: pytest.fail("no bucket is left open"))
    first = "a line of some length that two documents hold, but for the last of its many words: one"
    second = f"{first[:-3]}two"
    a, b = line_dedup.signatures([first.encode(), second.encode()], 104).reshape(2, 26, 4)
    common = int((a == b).all(1).sum())
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.without_repeated_lines(table({1: first, 2: second, 3: "nothing of the kind is found in here"})).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    assert 0 < common < 26 and made.value == 2 * 2 * common  # counted once, met once
