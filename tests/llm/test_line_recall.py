"""Links between lines that the bands and the marks must not lose."""

import random

import xxhash

from tallyseq.llm import line_dedup
from tests.llm import brute


def removed(table, docs):
    return {r["doc_id"]: r["n_removed"] for r in line_dedup.without_repeated_lines(table(docs)).collect()}


def test_no_pair_at_the_threshold_is_missed(table):
    """2000 pairs of lines at a similarity of 89 / 111 = 0.802."""
    rng = random.Random(12)
    first, second = [], []
    for _ in range(2000):
        x = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(107)]
        y = list(x)
        y[40], y[-3] = "0", "1"
        first.append("".join(x)), second.append("".join(y))
    docs = {i: "\n".join(first[50 * i : 50 * i + 50]) for i in range(40)} | {100 + i: "\n".join(second[50 * i : 50 * i + 50]) for i in range(40)}
    a, b = ({x[k : k + 8] for k in range(100)} for x in (first[0], second[0]))
    assert brute.close(a, b, 80) and not brute.close(a, b, 81)
    assert removed(table, docs) == {i: 0 for i in range(40)} | {100 + i: 50 for i in range(40)}


def test_near_lines_whose_hashes_end_alike_are_two_lines(table):
    base, seen = "a line of some length that two documents hold, but for a number near its end, and which goes on a while: ", {}
    for k in range(1000, 9999):
        line = f"{base}{k} of them"
        other = seen.setdefault(xxhash.xxh3_64_intdigest(line.encode()) & 0xFFFF, line)
        if other != line:
            break
    assert other != line
    assert removed(table, {1: other, 2: line}) == {1: 0, 2: 1}
