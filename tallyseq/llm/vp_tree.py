"""Nearest neighbours by vantage-point trees, one for each shard of the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAF = 64
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Node:
    """A ball around ``centre``; ``near`` and ``far`` are its halves by distance, each with its least and greatest distance."""

    __slots__ = ("centre", "near", "far", "near_range", "far_range", "rows")

    def __init__(self) -> None:
        self.centre = self.near = self.far = self.rows = None


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` and ``b``, each difference squared and summed in double precision."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        d = b - a[i]
        out[i] = np.sqrt((d * d).sum(1))
    return out


def build(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> Node:
    """Halves by rank of distance, so equal vectors still split evenly."""
    node = Node()
    if len(rows) <= LEAF:
        node.rows = rows
        return node
    pick = int(rng.integers(len(rows)))
    node.centre = rows[pick]
    rest = np.delete(rows, pick)
    d = distances(x[node.centre][None], x[rest])[0]
    order = np.argsort(d, kind="stable")
    rest, d, half = rest[order], d[order], len(order) // 2
    node.near_range, node.far_range = (d[0], d[half - 1]), (d[half], d[-1])
    node.near, node.far = build(x, rest[:half], rng), build(x, rest[half:], rng)
    return node


class Search:
    """The ``k`` nearest so far of each query, searched together through one tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> None:
        self.x, self.ids, self.q, self.qid, self.k, self.factor = x, ids, queries, query_ids, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, who: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Merges candidates ``ids`` at distances ``d`` (a row for each of ``who``); ties go to the smaller id."""
        d = np.where(ids[None] == self.qid[who][:, None], np.inf, d)
        alld = np.concatenate([self.best[who], d], 1)
        alli = np.concatenate([self.found[who], np.broadcast_to(ids, d.shape)], 1)
        order = np.lexsort((alli, alld), axis=1)[:, : self.k]
        self.best[who], self.found[who] = np.take_along_axis(alld, order, 1), np.take_along_axis(alli, order, 1)

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.rows is not None:
            if len(node.rows):
                self.offer(who, distances(self.q[who], self.x[node.rows]), self.ids[node.rows])
            return
        d = distances(self.q[who], self.x[node.centre][None])
        self.offer(who, d, self.ids[[node.centre]])
        d = d[:, 0]
        nearer = d <= (node.near_range[1] + node.far_range[0]) / 2
        for mine, halves in ((nearer, ("near", "far")), (~nearer, ("far", "near"))):
            for half in halves:
                low, high = getattr(node, f"{half}_range")
                # no vector of the half is closer than this, by the triangle inequality
                bound = np.maximum(low - d, d - high)
                open_ = mine & (bound * (1 - 1e-12) - 1e-12 <= self.factor * self.best[who, -1])
                self.visit(getattr(node, half), who[open_])


def searched(k: int, factor: float, block: int):
    """cogroup function: the tree of a shard against all queries, a block at a time."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        x, q = (np.array(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (vectors, queries))
        ids, qid = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        tree = build(x, np.arange(len(x)), np.random.default_rng(len(x)))
        out = []
        for at in range(0, len(q), block):
            s = Search(x, ids, q[at : at + block], qid[at : at + block], k, factor)
            s.visit(tree, np.arange(len(s.q)))
            good = np.isfinite(s.best)
            out.append(pa.table([np.repeat(s.qid, good.sum(1)), s.found[good], s.best[good]], schema=FOUND))
        return pa.concat_tables(out)

    return run


def usable(v: Column) -> Column:
    """Not null or empty, no null, NaN or infinite component, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, per_shard: int = 4096, block: int = 512) -> DataFrame:
    """For each row of ``queries(query_id, v)`` its ``k`` nearest of ``vectors(vec_id, v)``: query_id, rank, vec_id, score.

    A row whose vec_id is the query's own is no candidate. Nearness is the Euclidean distance in double precision, ties
    to the smaller vec_id, rank from 1; fewer candidates give fewer rows. Every vector is indexed: shards of about
    ``per_shard`` each hold a vantage-point tree. Each shard gets all queries, so tasks are as many as shards and hold one
    shard, one set of queries and ``block`` searches; the shards' lists are then ranked together. A half of a ball is skipped
    when its lower bound exceeds ``factor`` times the distance of the k-th found so far: 1 is exact, less is faster.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids; vectors are
    only compared with those of as many components. Repeated rows of one id and vector count once. Empty table: no rows. Other columns are ignored.
    """
    wide = lambda c: F.transform(c, lambda x: x.cast("double")).alias("v")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), wide("v")).where(F.col("query_id").isNotNull() & usable(F.col("v"))).distinct()
    shards = max(1, -(-vectors.count() // per_shard))
    placed = vectors.withColumn("size", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    sent = queries.withColumn("size", F.size("v")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = placed.groupBy("size", "shard").cogroup(sent.groupBy("size", "shard")).applyInArrow(searched(k, factor, block), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
