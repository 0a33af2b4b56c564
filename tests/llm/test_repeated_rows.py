"""Rows that stand in the table several times."""

import numpy as np

from tallyseq.llm import line_dedup, neardup


def family(rng, prefix, n, shared=93):
    """Sets of 100 values: ``shared`` in common with all of the family, the others private."""
    core = rng.integers(1, 1 << 62, shared, dtype=np.uint64)
    return {prefix + i: np.unique(np.concatenate([core, rng.integers(1, 1 << 62, 100 - shared, dtype=np.uint64)])) for i in range(n)}


def test_a_large_bucket_of_two_families_with_repeated_rows(spark):
    """One bucket of two families of 20; each set comes in three rows."""
    rng = np.random.default_rng(7)
    sets = family(rng, 100, 20) | family(rng, 200, 20)
    sig = np.arange(4, dtype=np.uint32).tobytes()  # equal minima: all share the one bucket, whose pivot connects one family; none is pruned
    classes = spark.createDataFrame([(i, len(x), sig) for i, x in sets.items()], "id long, n long, sig binary")
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in sets.items() for _ in range(3)], "id long, shingles binary")
    got = {r["id"]: r["component"] for r in neardup.links(classes, lambda ids: rows.join(ids, "id", "left_semi"), 85, 1, 4).collect()}
    assert got == {i: i // 100 * 100 for i in sets}


def test_equal_blocks_keep_one_copy_of_a_line(spark):
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(5, "one line of text\nand another one")] * 3, 3), "doc_id long, text string")
    got = sorted(r["n_removed"] for r in line_dedup.without_repeated_lines(docs).collect())
    assert got == [0, 2, 2]
