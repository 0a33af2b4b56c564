"""Lines of one template, most of them just too far apart: pairs don't leave the groups in which lines meet, and no link is lost."""

import random

import pytest

from tallyseq.llm import line_dedup, neardup


def copies(seed, n, changes):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(600)]
    base = rng.choices(words, k=50)
    out = []
    for _ in range(n):
        mine = list(base)
        for at in rng.sample(range(50), rng.choice(changes)):
            mine[at] = rng.choice(words[:9])
        out.append(" ".join(mine))
    return list(dict.fromkeys(out))


def expected(lines):
    """Line numbers that lose against an earlier line of their component."""
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    label = list(range(len(lines)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    return {i for i, v in enumerate(label) if v != i}


@pytest.mark.parametrize("rows, pairwise", [(1024, 64), (20, 64), (20, 3)])
def test_pairs_of_one_template(table, monkeypatch, spark, rows, pairwise):
    lines = copies(3, 150, (2, 3, 4))
    monkeypatch.setattr(neardup, "GROUP_ROWS", rows)
    monkeypatch.setattr(neardup, "PAIRWISE", pairwise)
    groups, linked = neardup.near_pairs, neardup.linked
    left, sent = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(function, before, seen):
        def run(batches):
            def inner():
                for b in batches:
                    seen.add(b.num_rows if before else 0)
                    yield b

            for b in function(inner()):
                seen.add(0 if before else b.num_rows)
                yield b

        return run

    monkeypatch.setattr(neardup, "near_pairs", lambda *args: counted(groups(*args), False, left))
    monkeypatch.setattr(neardup, "linked", lambda *args: counted(linked(*args), True, sent))
    got = {r["doc_id"] for r in line_dedup.without_repeated_lines(table(dict(enumerate(lines)))).where("n_removed = 1").collect()}
    want = expected(lines)
    assert got == want and 20 < len(want) < len(lines) - 20
    if rows > 20 or pairwise < 20:  # else pairs of small groups are in the count
        assert sent.value <= 1500  # those with a pivot
        assert left.value <= len(lines)
