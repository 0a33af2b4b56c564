"""Near-duplicate documents: MinHash bands, Bayesian verification of signature batches, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm.common import cut, mix64
from tallyseq.llm.neardup import links

CHUNK = 8192


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the word shingles; A-Z lower-cased.

    Fewer words than ``width``: the whole sequence is one shingle. No word: empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], np.uint64)
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = mix64(out) + h[i : len(h) - width + 1 + i]
    return np.unique(mix64(out))


def minima(values: np.ndarray, k: int) -> np.ndarray:
    """``k`` independent 32-bit minima, a chunk of the set at a time."""
    rng = np.random.default_rng(20240611)
    a = (rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    c = rng.integers(0, 1 << 63, k, dtype=np.uint64)[:, None]
    low = np.full(k, ~np.uint64(0))
    for at in range(0, len(values), CHUNK):
        np.minimum(low, (values[None, at : at + CHUNK] * a + c).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signed(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in b.column("text").to_pylist()]
            prints = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array([minima(s, k).tobytes() for s in sets], pa.binary())], ["doc_id", "n_shingles", "print", "sig"])

    return run


def sets_from(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t, width).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["id", "shingles"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, bands: int = 24, rows: int = 4, miss: float = 1e-9) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their distinct
    word shingles. component_id: the smallest doc_id reachable over links. Documents with equal
    shingle sets are one class with one representative, so a large group of copies costs one row.
    ``bands`` of ``rows`` minima miss a pair at the threshold with probability
    (1 - (percent / 100) ** rows) ** bands, about 2e-8 with the defaults.

    Null text or no words: the empty set, linked with nothing. Rows with a null doc_id take no
    part: component_id null, kept false. Repeated rows are copies: same component_id. If one doc_id has
    several texts, the links of all of them are joined. Empty table: no rows. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows_ = cut(base.mapInArrow(signed(bands * rows, width), "doc_id long, n_shingles long, print binary, sig binary"))
    classes = rows_.where("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = base.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
        return cut(texts.mapInArrow(sets_from(width), "id long, shingles binary"))

    found = links(classes, sets_of, percent, bands, rows, miss=miss)
    per_class = classes.select("print", "id").join(found, "id", "left").select("print", F.coalesce("component", "id").alias("class_component"))
    out = rows_.select("doc_id", "n_shingles", "print").join(per_class, "print", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """``docs(doc_id, text, ...)`` with one row of each component, that of the smallest doc_id; columns as they were.

    Rows that are linked with nothing stay, also those without words. Of rows with equal doc_ids one stays, except that
    rows with a null doc_id all stay.
    """
    ids = near_duplicates(docs, **settings).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    known = docs.where("doc_id is not null")
    one = known.join(ids, known["doc_id"].cast("long") == ids["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
