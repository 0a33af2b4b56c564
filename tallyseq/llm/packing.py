"""Packing by optimal length buckets: dynamic programming over the global length histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyseq.llm.common import cut

RUN = 10_000  # equal pieces that one row stands for while positions are made

def chars(column: str) -> Column:
    return F.length(column).cast("long")


def boundaries(histogram: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    ``histogram[i]``: pieces of length i, i >= 1. cost[j] is the least padding of all pieces up to length j, with j a boundary;
    each of ``buckets`` rounds extends it by one bucket. The last boundary is the largest length.
    """
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    count, total = (np.concatenate([[0], np.cumsum(x)]) for x in (histogram[lengths].astype(np.float64), (histogram[lengths] * lengths).astype(np.float64)))
    m = len(lengths)
    best, back = np.full(m + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        now, frm = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        now[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + (count[j] - count[:j]) * lengths[j - 1] - (total[j] - total[:j])
            frm[j] = int(np.argmin(cost))
            now[j] = cost[frm[j]]
        best = now
        back.append(frm)
    out, j = [], m
    for frm in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = frm[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, longest: int = 2048, budget: int = 65_536, per_shard: int = 50_000) -> DataFrame:
    """One row per piece of each row of ``docs(doc_id, text)``: doc_id, piece, n_tokens, bucket_len, batch_id, slot, padding.

    A token is a word (a run without ASCII white space). A text of over ``longest`` tokens is cut into pieces of ``longest``, the
    last shorter; piece counts from 0 and all tokens are kept. The histogram of piece lengths has ``longest`` entries at
    most, whatever the data, so it goes to the driver; dynamic programming picks ``buckets`` boundaries with the
    least padding. Each piece is padded to its bucket's boundary. Inside a bucket, pieces ordered by (shard, doc_id,
    piece) fill batches of budget // bucket_len slots (one at least). Positions come from row numbers inside shards of about ``per_shard`` pieces plus the
    shards' offsets, so no bucket is ever one task; pieces of equal doc_id, number and length are one row with a count until they have positions, so one doc_id, or
    null, may hold any share of the rows.

    Null or empty text, or no word: one piece of no tokens with bucket_len 0, batch_id and slot null. Repeated rows are
    packed each. A null doc_id is packed like any other. Empty table: no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    # white-space runs between words, plus one, less the empty ends
    runs = F.size(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", -1))
    words = F.when(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", 0).otherwise(runs)
    sized = docs.select("doc_id", words.alias("n"))
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / longest).cast("int") - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("n_tokens"))
    # pieces of one doc_id, number and length are alike: they are counted before the shuffle, so no doc_id makes a hot shard; texts are read once
    alike = cut(pieces.groupBy("doc_id", "piece", "n_tokens").agg(F.count("*").alias("held")))
    histogram = np.zeros(longest + 1, np.int64)
    for r in alike.groupBy("n_tokens").agg(F.sum("held").alias("held")).collect():
        histogram[r["n_tokens"]] = r["held"]
    ends = boundaries(histogram, buckets)
    length = F.lit(0)
    for end in reversed(ends):
        length = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(length)
    length = F.when(F.col("n_tokens") == 0, F.lit(0)).otherwise(length)
    shards = max(1, -(-int(histogram.sum()) // per_shard))
    placed = alike.withColumn("bucket_len", length).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int"))
    counts = placed.groupBy("bucket_len", "shard").agg(F.sum("held").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("bucket_len", "shard", before.alias("before"))
    inside = F.sum("held").over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "piece", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    at = placed.withColumn("inside", inside).join(counts, ["bucket_len", "shard"]).withColumn("first", F.col("before") + F.col("inside"))
    at = at.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1, F.lit(RUN).cast("long"))))
    at = at.withColumn("at", F.explode(F.sequence(F.col("first") + F.col("run"), F.col("first") + F.least(F.col("held"), F.col("run") + RUN) - 1)))
    slots = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    real = F.col("bucket_len") > 0
    return at.withColumn("slots", slots).select(
        "doc_id", F.col("piece").cast("long").alias("piece"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("bucket_len").cast("long").alias("bucket_len"),
        F.when(real, F.concat_ws("-", F.col("bucket_len").cast("string"), F.floor(F.col("at") / F.col("slots")).cast("string"))).alias("batch_id"),
        F.when(real, F.col("at") % F.col("slots")).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).cast("long").alias("padding"),
    )
