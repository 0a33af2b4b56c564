"""Pairs of one large bucket that bounds show to be too far apart don't reach the exact check; linked ones do."""

import numpy as np
import pytest

from tallyseq.llm import neardup


def sets_with_rare_shingle_in_common(rng):
    """Half of each set is common to all, one shingle to two neighbours."""
    return [np.concatenate([np.arange(1, 51), [1000 + i // 2], rng.integers(1 << 40, 1 << 60, 49)]) for i in range(60)]


def sets_of_common_shingles(rng):
    """100 of the same 150 shingles each; the last five are near the first."""
    pool = rng.integers(1, 1 << 60, 150)
    made = [rng.choice(pool, 100, replace=False) for _ in range(55)]
    return made + [np.append(made[0][:97], pool[-k - 1]) for k in range(5)]


@pytest.mark.parametrize("make, most", [(sets_with_rare_shingle_in_common, 59), (sets_of_common_shingles, 600)])
def test_far_pairs_are_left_out(spark, monkeypatch, make, most):
    rng = np.random.default_rng(7)
    sets = [np.unique(x).astype(np.uint64) for x in make(rng)]
    sigs = rng.integers(0, 1 << 32, (len(sets), 8), dtype=np.uint32)
    sigs[:, :4] = 5  # one bucket of all
    classes = spark.createDataFrame([(i, len(x), sigs[i].tobytes()) for i, x in enumerate(sets)], "id long, n long, sig binary")
    texts = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id long, shingles binary")
    checked, exact = spark.sparkContext.accumulator(0), neardup.linked

    def counted(percent, decode):
        keep = exact(percent, decode)

        def run(batches):
            def seen():
                for b in batches:
                    checked.add(b.num_rows)
                    yield b

            yield from keep(seen())

        return run

    monkeypatch.setattr(neardup, "linked", counted)
    got = {r["id"]: r["component"] for r in neardup.links(classes, lambda _: texts, 80, 2, 4, miss=None).collect()}
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    assert got == {i: v for i, v in enumerate(label) if label.count(v) > 1}
    assert checked.value <= most
