"""Merkle manifest of a data set: trees of eight-way nodes for each group, a tree of their roots above, and proofs.

Executors work on aligned buckets of 512 consecutive nodes of a tree, as Arrow tables, in DuckDB: three levels are three queries with an ordered
string_agg under sha256. Spark combines: the buckets' roots are the nodes of the next round, until a tree is one node; on the way
back each bucket gets the proof of its root, which all of its nodes share. No group, however large, meets in one task.
"""

from __future__ import annotations

import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyseq.operators.barcode import small
from tallyseq.operators.common import cut, shared_folder

FANOUT, LEVELS = 8, 3
BUCKET = FANOUT**LEVELS
NODES = "tree string, pos long, n long, h string"
ROOTS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())])
PROOF = "array<struct<place int, others string>>"
PROOF_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
UP = f"select i // {FANOUT} as i, sha256(string_agg(h, '' order by i)) as h from level group by i // {FANOUT}"
RUNS = f"select i // {FANOUT} as i, string_agg(h, '' order by i) as run from level group by i // {FANOUT}"


def placed(df: DataFrame, tree: str, *order: Column) -> DataFrame:
    """Adds pos (0-based place of the row in its ``tree`` by ``order``) and n (rows of the tree).

    Rows are dealt by range and sorted, so a large tree lies in many partitions; they are written to the shared folder with the number of their
    partition and of the row in it, and the partitions' counts, one row for each tree in each, give what lies before. Rows that agree in
    all of ``order`` are dealt by their number in the input.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/placed-{uuid.uuid4().hex}"
    keys = [F.col(tree).asc_nulls_first(), *order, F.col("number_in_input")]
    ranged = df.withColumn("number_in_input", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.drop("number_in_input").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("part", F.shiftright("row", 33))
    parts = rows.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("held"))
    of = Window.partitionBy(tree)
    before = F.sum("held").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    parts = parts.select(F.col(tree).alias("its_tree"), F.col("part").alias("its_part"), (before - F.col("first")).alias("shift"), F.sum("held").over(of).alias("n"))
    joined = rows.join(small(cut(parts)), F.col(tree).eqNullSafe(F.col("its_tree")) & (F.col("part") == F.col("its_part")))
    return joined.withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "its_tree", "its_part", "shift")


@cache
def engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.execute("set memory_limit = '256MB'")
    return con


def levels_of(bucket: pa.Table) -> list[pa.Table]:
    """Levels (i, h) of a bucket from its nodes up: three steps, or as many as leave one node where the bucket is the whole tree."""
    n, con = bucket.column("n")[0].as_py(), engine()
    level = con.from_arrow(bucket).query("nodes", f"select pos % {BUCKET} as i, h from nodes").to_arrow_table()
    out = [level]
    while len(out) <= LEVELS and (n > BUCKET or len(level) > 1):
        level = con.from_arrow(level).query("level", UP).to_arrow_table()
        out.append(level)
    return out


def bucket_root(bucket: pa.Table) -> pa.Table:
    tree, pos, n = bucket.column("tree")[0], bucket.column("pos")[0].as_py(), bucket.column("n")[0].as_py()
    (root,) = levels_of(bucket)[-1].column("h").to_pylist()
    return pa.table([[tree.as_py()], [pos // BUCKET], [-(-n // BUCKET)], [root]], schema=ROOTS)


def bucket_proofs(bucket: pa.Table, above: pa.Table) -> pa.Table:
    """Nodes of a bucket with their proofs; ``above`` has the proof of the bucket's root."""
    con, levels = engine(), levels_of(bucket)
    columns, joins = [], []
    for k, level in enumerate(levels[:-1]):
        con.register(f"runs{k}", con.from_arrow(level).query("level", RUNS).to_arrow_table())
        place = f"((pos % {BUCKET}) // {FANOUT**k} % {FANOUT})::int"
        columns.append(f"{{'place': {place}, 'others': substr(runs{k}.run, 1, 64 * {place}) || substr(runs{k}.run, 64 * {place} + 65)}}")
        joins.append(f" join runs{k} on runs{k}.i = pos % {BUCKET} // {FANOUT ** (k + 1)}")
    con.register("nodes", bucket)
    con.register("outer_proof", above)
    own = f"[{', '.join(columns)}]" if columns else "[]::struct(place int, others varchar)[]"
    found = con.sql(f"select nodes.*, list_concat({own}, (select proof from outer_proof)) as proof from nodes{''.join(joins)}").to_arrow_table()
    for name in ("nodes", "outer_proof", *[f"runs{k}" for k in range(len(levels) - 1)]):
        con.unregister(name)
    return found.cast(bucket.schema.append(pa.field("proof", PROOF_TYPE)))


def bucketed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("pos") / BUCKET))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(tree, pos, n, h)`` and the tables of bucket roots above it; in the last, each tree is one node."""
    out = [nodes]
    while True:
        found = cut(bucketed(out[-1].select(*ROOTS.names)).groupBy("tree", "bucket").applyInArrow(bucket_root, NODES))
        out.append(found)
        if not found.where("n > 1").take(1):
            return out


def proofs(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of rounds(), with all their columns and proof: from ``above(tree, pos, proof)`` of the roots down to the nodes."""
    known = above
    for nodes in reversed(tables[:-1]):
        pairs = bucketed(nodes).groupBy("tree", "bucket").cogroup(known.select("tree", F.col("pos").alias("bucket"), "proof").groupBy("tree", "bucket"))
        columns = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
        known = pairs.applyInArrow(lambda t, a: bucket_proofs(t.drop_columns("bucket"), a.select(["proof"])), f"{columns}, proof {PROOF}")
        known = cut(known) if nodes is not tables[0] else known
    return known


def element(column: str) -> Column:
    """A value as it enters a leaf: - for null, else its UTF-8 bytes' number, a colon and itself."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*elements: Column) -> Column:
    return F.sha2(F.concat(*elements), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    step = lambda h, p: F.sha2(F.concat(F.substring(p["others"], F.lit(1), 64 * p["place"]), h, F.substring(p["others"], 64 * p["place"] + 1, F.length(p["others"]))), 256)
    return F.aggregate(proof, start, step)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, tampered: Column | None = None, group: str = "lang") -> DataFrame:
    """Leaves of ``docs(doc_id, source, lang, n_chars, text)`` with subroot, root and proof: doc_id, tree, pos, leaf, touched, subroot, root, proof.

    A leaf hashes the five columns (see element()). Leaves of a group ascend by doc_id (nulls first; rows of one doc_id by leaf; equal rows in any
    order), every 8 consecutive nodes become one until one remains, the group's subroot; subroots by group (null first, then bytewise) make the
    root likewise. proof: for each level up to the root the node's place in its run and the run's other nodes, joined. ``tampered``: another value of
    text, whose leaf is ``touched``. Null group: a group of its own; empty or null texts, equal rows and single groups have leaves and
    proofs as any other; empty table: no rows; other columns are ignored.
    """
    parts = {c: element(c) for c in FIELDS}
    changed = parts | {"text": element("other_text")}
    rows = docs.withColumn("other_text", F.col("text") if tampered is None else tampered)
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = rows.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(*parts.values()).alias("leaf"), leaf(*changed.values()).alias("touched"))
    leaves = placed(leaves, "tree", F.col("doc_id").asc_nulls_first(), F.col("leaf").asc())
    leaves = leaves.withColumnRenamed("leaf", "h").select("tree", "pos", "n", "h", "doc_id", "touched")
    lower = rounds(leaves)
    tops = placed(lower[-1].select(F.lit("").alias("top"), F.col("tree").alias("name"), F.col("h")), "top", F.col("name").asc())
    upper = rounds(cut(tops.select(F.col("top").alias("tree"), "pos", "n", "h", "name")))
    root = upper[-1].first()  # a hash of 64 bytes, or None over an empty table
    ends = cut(proofs(upper, upper[-1].select("tree", "pos", F.array().cast(PROOF).alias("proof"))))
    found = proofs(lower, ends.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof"))
    named = found.join(small(ends.select(F.col("name").alias("tree"), F.col("h").alias("subroot"))), "tree")
    return named.select("doc_id", "tree", "pos", F.col("h").alias("leaf"), "touched", "subroot", F.lit(root and root["h"]).cast("string").alias("root"), "proof")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of manifest()."""
    joined = F.array_join(F.transform("proof", lambda p: p["others"]), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), folded(F.col("touched"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(every: int = 3) -> Column:
    """text with A-Z in lower case where ``every`` divides the crc32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(hit, F.translate("text", letters, letters.lower())).otherwise(F.col("text"))
