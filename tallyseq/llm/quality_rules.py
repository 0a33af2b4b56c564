"""Quality rules: heuristics, and a hashed n-gram log-likelihood ratio of trusted text against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm.common import mix64

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def word_hashes(data: bytes) -> np.ndarray:
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the words and word pairs."""
    two = mix64(h[:-1]) + h[1:] if len(h) > 1 else h[:0]
    return (mix64(np.concatenate([h, two])) >> np.uint64(64 - bits)).astype(np.int64)


def repeated(h: np.ndarray, width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs twice or more."""
    n = len(h) - width + 1
    if n < 2:
        return 0
    w = h[:n].copy()
    for i in range(1, width):
        w = mix64(w) + h[i : n + i]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for i in range(width):
        covered[i : n + i] |= twice
    return int(covered.sum())


def measures(text: str) -> tuple[np.ndarray, int, int, int, int]:
    """Hashes of the words, then word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    h = word_hashes(text.encode())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return h, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(h)


def counted(bits: int):
    """mapInArrow function: (text, trusted) to (bucket, raw, trusted), one row for each bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            for text, trusted in zip(b.column("text"), b.column("trusted").to_pylist(), strict=True):
                n = np.bincount(grams(word_hashes((text.as_py() or "").encode().lower()), bits), minlength=1 << bits)
                totals[0] += n
                if trusted:
                    totals[1] += n
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, totals[0][used], totals[1][used])], ["bucket", "raw", "trusted"])

    return run


def log_ratio(docs: DataFrame, trusted: DataFrame, bits: int = 16, most: int = 20_000, smoothing: float = 1.0) -> np.ndarray:
    """log(p_trusted / p_raw) of each of the 2 ** ``bits`` buckets, from all of ``docs(doc_id, text)``.

    Raw counts cover every document. Trusted counts cover the ``most`` doc_ids of ``trusted(doc_id)`` that come first by
    hash (all, if fewer), so that their ids have a bounded size and are broadcast. What reaches the driver
    is one row for each bucket at most.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    rows = flagged.select("text", F.col("trusted_id").isNotNull().alias("trusted")).mapInArrow(counted(bits), "bucket long, raw long, trusted long")
    table = np.zeros((2, 1 << bits))
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect():
        table[:, r.bucket] = r.raw, r.trusted
    p = (table + smoothing) / (table.sum(1, keepdims=True) + smoothing * table.shape[1])
    return np.log(p[1] / p[0])


def judged(ratio, bits: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = ratio.value
        for b in batches:
            rows = []
            for text in b.column("text"):
                text = text.as_py() or ""
                h, *counts = measures(text)
                at = grams(word_hashes(text.encode().lower()), bits)
                llr = float(weights[at].sum() / len(at)) if len(at) else None
                failed = len(h) < 50 or 100 * counts[3] > 50 * len(h)
                rows.append((len(h), *counts, failed, not failed and llr is not None and llr >= threshold, llr))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])

    return run


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = -0.25, bits: int = 16, most: int = 20_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    llr: mean over the words and word pairs (A-Z lower-cased) of the log ratio of their probabilities under trusted and
    raw text, multinomials over 2 ** ``bits`` hash buckets. kept: not base_failed (fewer than 50 words, or over
    half of the words repeated) and llr >= ``threshold``, the same for every document.

    Null text counts as empty: zeros, llr null, base_failed. No trusted document: the smoothed trusted
    distribution is uniform. Repeated rows each get the same answer. Empty table: no rows. Other columns are ignored.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, trusted, bits, most).astype(np.float32))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged(ratio, bits, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double")
