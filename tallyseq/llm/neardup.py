"""Near-duplicate links between sets: banded MinHash, sequential Bayesian pruning, exact check.

The input is one row per distinct set, ``classes(id long, n long, sig binary)``; ``sig``
holds ``bands * rows`` 32-bit minima. Buckets of equal bands propose pairs without
writing out all pairs of a bucket. First every member meets one pivot of its bucket, the one with most company
in all its buckets. What follows concerns only buckets whose members still belong to different components. Those of up to SMALL members
check every such pair. In larger ones, sets that share a rare shingle (RARE holders at most) are paired through
it. For all other pairs no rare shingle is in the intersection, which bounds the similarity; under that bound 16, 128,
1024 ... pivots meet the members of other components, until one component is left or every member has been a pivot. A bucket is thus never
collected, and every pair that shares a bucket is checked, provably too far apart or already connected.

Sets that are small enough to travel with each of their places in a bucket (lines) go another way after the pivots, with ``blocked``: the members
of a bucket meet in groups of bounded size, where pairs are checked and only links between different components leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm.common import components, cut, mix64, release


RARE = 8
SMALL = 16
CELLS = 1024
WORDS = [f"bits{k}" for k in range(CELLS // 64)]
DECODED = 32_000_000  # bytes of sets that a task remembers
GROUP_ROWS, GROUP_SHINGLES = 1024, 500_000  # about as many of a bucket are a chunk; two chunks meet in a group
PAIRWISE = 64  # groups of up to so many members check pair by pair
BITS = 4_000_000  # bytes of bit rows that are compared at once
BROADCAST_ROWS = 400_000  # of labels or keys, some 16 bytes each


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Smallest number of equal minima among ``n`` that is not pruned.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose
    mass at or above ``threshold`` is P(Binomial(n + 1, threshold) <= m); a pair is pruned when
    that is below ``miss``.
    """
    mass = 0.0
    for m in range(n + 1):
        mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if mass >= miss:
            return m
    return n


def survivors(threshold: float, miss: float, batch: int) -> Callable:
    """mapInArrow function: keeps the (a, b) whose signatures survive every batch."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive, equal, k = np.arange(b.num_rows), np.zeros(b.num_rows, int), x.shape[1]
            for at in range(0, k, batch):
                end = min(at + batch, k)
                equal[alive] += (x[alive, at:end] == y[alive, at:end]).sum(1)
                alive = alive[equal[alive] >= least_matches(end, threshold, miss)]
            yield b.select(["a", "b"]).take(pa.array(alive))

    return keep


def stored(data: list[bytes]) -> list[np.ndarray]:
    """Sets that are stored as they are."""
    return [np.frombuffer(x, np.uint64) for x in data]


def linked(percent: int, decode: Callable) -> Callable:
    """mapInArrow function: keeps the (a, b) with 100 * intersection >= percent * union on the full sets."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # a set stands in many pairs
        held = 0
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            left, right = (b.column(c).to_pylist() for c in ("set_a", "set_b"))
            if held > DECODED:
                known, held = {}, 0
            new = list({x for x in (*left, *right) if x not in known})
            for x, values_ in zip(new, decode(new), strict=True):
                known[x] = values_
                held += len(x) + values_.nbytes
            good = []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                x, y = known[x], known[y]
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(i)
            yield b.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return keep


def band_keys(bands: int, rows: int) -> Callable:
    """mapInArrow function: (id, n, sig) to one (key, id, n) for each band, or, with a column held of 16-bit numbers of bands, for those."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, bands, rows)
            key = np.broadcast_to(salt, (b.num_rows, bands)).copy()
            for r in range(rows):
                key = mix64(key ^ sig[:, :, r])
            many = bands
            if "held" in b.schema.names:
                held = b.column("held").to_pylist()
                many = [len(x) // 2 for x in held]
                key = key[np.repeat(np.arange(b.num_rows), many), np.frombuffer(b"".join(held), np.uint16)]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64))] + [pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), many)) for c in ("id", "n")], ["key", "id", "n"])

    return keys


def values(decode: Callable) -> Callable:
    """mapInArrow function: (id, shingles) to one (value, id) for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            sets = decode(b.column("shingles").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(b.column("id").to_numpy(zero_copy_only=False), [len(x) for x in sets]))], ["value", "id"])

    return run


def cells(decode: Callable) -> Callable:
    """mapInArrow function: (id, shingles) to the id and a bit for each of CELLS parts of the hashes, set where the set has a hash there, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            there = np.zeros((b.num_rows, CELLS), np.uint8)
            for i, x in enumerate(decode(b.column("shingles").to_pylist())):
                there[i, (x % np.uint64(CELLS)).astype(np.int64)] = 1
            words = np.packbits(there, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(words[:, k].copy()) for k in range(CELLS // 64)]], ["id", *WORDS])

    return run


def key_lists(bands: int, rows: int) -> Callable:
    """mapInArrow function: (id, n, sig) to (id, keys): the bucket of each band."""
    keys = band_keys(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in keys(batches):
            ids = b.column("id").to_numpy()[::bands]
            lists = b.column("key").to_numpy().reshape(len(ids), bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in lists], pa.binary())], ["id", "keys"])

    return run


def near_pairs(percent: int, decode: Callable, bands: int) -> Callable:
    """mapInArrow function: rows by (key, lo, hi) to the (a, b) that link different labels, in large groups as many as connect what is linked.

    A pair is checked in the bucket of the first band that both have in common, of two chunks if the group is made of two.
    """

    def apart(rows: pa.Table, n: np.ndarray) -> Callable:
        """Which pairs of members (i, j) are to be checked."""
        label, chunk, key, lo, hi = (rows.column(c).to_numpy() for c in ("label", "chunk", "key", "lo", "hi"))
        lists = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(rows.num_rows, bands)
        band = (lists == key[:, None]).argmax(1)

        def some(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            keep = (label[i] != label[j]) & ((lo[i] == hi[i]) | (chunk[i] != chunk[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            which = np.flatnonzero(keep)
            for k in range(int(band.max(initial=0))):
                which = which[(band[i[which]] <= k) | (lists[i[which], k] != lists[j[which], k])]
            return which

        return some

    def pairwise(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of small groups."""
        out = [np.zeros((0, 2), np.int64)]
        some, found = apart(rows, rows.column("n").to_numpy()), []
        for size in np.unique(sizes):
            first, (x, y) = starts[sizes == size], np.triu_indices(int(size), 1)
            step = max(1, BITS // (8 * max(1, len(x))))
            for at in range(0, len(first), step):
                i, j = (np.add.outer(first[at : at + step], z).ravel() for z in (x, y))
                which = some(i, j)
                found.append(np.stack([i[which], j[which]], 1))
        ids, sets = rows.column("id").to_numpy(), rows.column("shingles").combine_chunks()
        pairs = np.concatenate(found)

        def texts() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pairs), 256):
                of = pairs[at : at + 256]
                yield pa.RecordBatch.from_arrays([*(pa.array(ids[of[:, k]]) for k in (0, 1)), *(sets.take(pa.array(of[:, k])) for k in (0, 1))], ["a", "b", "set_a", "set_b"])

        for good in linked(percent, decode)(texts()):
            out.append(np.stack([good.column(c).to_numpy() for c in ("a", "b")], 1))
        pairs = np.concatenate(out)
        return pairs[:, 0], pairs[:, 1]

    def crossing(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Links of one large group: a bit for each shingle that two members hold."""
        n, label, ids = (rows.column(c).to_numpy() for c in ("n", "label", "id"))
        some, found, wide = apart(rows, n), [], max(1, BITS // (8 * rows.num_rows))
        for at in range(0, rows.num_rows, wide):
            i, j = np.nonzero(np.triu(label[at : at + wide, None] != label, at + 1))
            which = some(i := i + at, j)
            found.append(np.stack([i[which], j[which]], 1))
        pairs = np.concatenate(found)
        used, pairs = np.unique(pairs, return_inverse=True)
        if not len(used):
            return used, used
        pairs, sets = pairs.reshape(-1, 2), decode(rows.column("shingles").take(pa.array(used)).to_pylist())
        n, label, ids = np.array(list(map(len, sets)), np.int64), np.unique(label[used], return_inverse=True)[1], ids[used]
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        code = np.where(count > 1, np.cumsum(count > 1), 0)[code]  # 0: held by one alone
        words = -(-int((count > 1).sum() + 1) // 64)
        bits, there = np.zeros((len(sets), 8 * words), np.uint8), np.zeros(64 * words, np.uint8)
        for k, mine in enumerate(np.split(code, np.cumsum(n)[:-1])):
            there[mine] = 1
            there[0] = 0
            bits[k] = np.packbits(there)
            there[mine] = 0
        bits, step, a, b = bits.view(np.uint64), max(1, BITS // (8 * words)), [], []
        for mine in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
            x, y = int(mine[0, 0]), mine[:, 1]
            y = y[label[y] != label[x]]
            for at in range(0, len(y), step):
                those = y[at : at + step]
                shared = np.bitwise_count(bits[those] & bits[x]).sum(1, dtype=np.int64)
                for z in those[100 * shared >= percent * (n[those] + n[x] - shared)].tolist():
                    if label[z] != label[x]:
                        label[label == label[z]] = label[x]
                        a.append(ids[x]), b.append(ids[z])
        return np.array(a, np.int64), np.array(b, np.int64)

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.stack([rows.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
        starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1)))
        sizes = np.diff(np.append(starts, len(group)))
        small = sizes <= PAIRWISE
        found = [pairwise(rows, starts[small], sizes[small])] if small.any() else []
        found += [crossing(rows.slice(at, size).combine_chunks()) for at, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True)]
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of = lambda b, at: tuple(b.column(c)[at].as_py() for c in ("key", "lo", "hi"))
        for b in (b for b in batches if b.num_rows):
            group = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
            last = int(np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1)))[-1])  # the last group may go on in the next batch
            if last or (held and of(held[-1], 0) != of(b, 0)):
                yield from joined(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from joined(pa.Table.from_batches(held))

    return run


def in_groups(open_: DataFrame) -> DataFrame:
    """Rows (key, id, n, label) of buckets as (key, lo, hi, chunk, id, n, label): each group (key, lo, hi) holds two chunks, or one, of its bucket.

    Members of different labels meet in a group. A bucket that is too large for one is cut into chunks, those of its most frequent label
    apart from the others, and no two of that label's chunks meet.
    """
    main = cut(open_.groupBy("key").agg(F.mode("label", deterministic=True).alias("main")))
    rows_ = open_.join(sent(main), "key").withColumn("minor", F.col("label") != F.col("main"))
    half = lambda of: F.ceil(F.greatest(F.count(of) / GROUP_ROWS, F.sum(of) / GROUP_SHINGLES)).cast("int")
    n = F.col("n")
    cuts = rows_.groupBy("key").agg(half(F.when(F.col("minor"), n)).alias("minors"), half(F.when(~F.col("minor"), n)).alias("majors"), half(n).alias("all"))
    rows_ = rows_.join(sent(cut(cuts)), "key")
    draw = lambda k: F.pmod(F.xxhash64("key", "id"), k).cast("int")
    whole = F.col("all") <= 2
    chunk = F.when(whole, 0).when(F.col("minor"), draw(F.col("minors"))).otherwise(F.col("minors") + draw(F.col("majors")))
    others = F.when(whole, F.array(F.lit(0))).when(F.col("minor"), F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    met = rows_.withColumn("chunk", chunk).select("key", "chunk", "id", "n", "label", F.explode(others).alias("other"))
    return met.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "id", "n", "label")


def sent(df: DataFrame) -> DataFrame:
    """Broadcast hint for a materialised table of labels or keys of at most BROADCAST_ROWS rows; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, bands: int, rows: int, decode: Callable = stored, miss: float | None = 1e-9, batch: int = 16, blocked: bool = False) -> DataFrame:
    """Components (id, component) of the classes that have a link.

    ``sets_of(ids)`` gives (id, shingles binary) for the ids that share a bucket, or for more; ``decode`` makes sorted
    distinct uint64 of a list of them. ``miss`` None leaves out the signatures' comparison: every pair goes to the exact check, which suits
    sets that are shorter than their signatures. ``blocked`` sends sets with each of their places in buckets that the pivots leave open, and needs
    one row for each id in ``sets_of``. A column held of ``classes`` names the bands in which a set may have company (16-bit numbers); the others are left out. Empty input, or no bucket of two, gives no rows.
    """
    banded = classes.select("id", "n", "sig", *({"held"} & set(classes.columns))).mapInArrow(band_keys(bands, rows), "key long, id long, n long")
    many = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(banded.join(many, "key"))
    ids = members.groupBy("id").agg(F.sum("size").alias("company"))
    sets = sets_of(ids.select("id"))
    sigs = None if miss is None else cut(classes.select("id", "sig").join(ids, "id", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if sigs is not None:
            for side in ("a", "b"):
                pairs = pairs.join(sigs.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}")), side)
            pairs = pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(survivors(percent / 100, miss, batch), "a long, b long")
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        return pairs.select("a", "b", "set_a", "set_b").mapInArrow(linked(percent, decode), "a long, b long")

    def opened(rows_: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of ``rows_`` in buckets that span components; components only merge, so a closed bucket stays closed."""
        labelled = rows_.select("key", "id", "n", "size").join(sent(labels), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        active = cut(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
        return cut(labelled.join(sent(active), "key"))

    def grown(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        release(classes.sparkSession)
        known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return components(known.unionByName(verified(pairs)))

    release(classes.sparkSession)
    order = F.shiftleft(F.least("company", F.lit((1 << 20) - 1)), 43) + F.shiftright(F.xxhash64("key", "id"), 21)  # by company, then at random; a long, so that it is aggregated by hash
    first = members.join(ids, "id").withColumn("order", order).groupBy("key").agg(F.max_by("id", "order").alias("x"), F.max_by("n", "order").alias("n_x"))
    near = f"100 * least(n, n_x) >= {percent} * greatest(n, n_x)"
    labels = components(verified(members.join(first, "key").where("id <> x").where(near).select("x", F.col("id").alias("y"))))

    open_ = opened(members, labels)
    if blocked:
        if not open_.take(1):
            return labels
        keys = classes.select("id", "n", "sig").join(open_.select("id").distinct(), "id", "left_semi").mapInArrow(key_lists(bands, rows), "id long, keys binary")
        full = in_groups(open_).join(keys.join(sets, "id"), "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        release(classes.sparkSession)
        found = full.mapInArrow(near_pairs(percent, decode, bands), "a long, b long")
        return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found))

    # small buckets: every pair of different components
    other = open_.where(F.col("size") <= SMALL).select("key", F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("label").alias("label_x"))
    pairs = cut(open_.where(F.col("size") <= SMALL).join(other, "key").where("id < x and label <> label_x").where(near).select("x", F.col("id").alias("y")).distinct())
    open_ = open_.where(F.col("size") > SMALL)
    if pairs.take(1):
        labels = grown(labels, pairs)
        open_ = opened(open_, labels)
    if not open_.take(1):
        return labels

    # large ones: sets that share a rare shingle meet through it; of the others an intersection holds no rare shingle
    loose = cut(open_.select("id", "n", "label").distinct())
    # sets may give an id in several rows: equal ones count once; an id of different sets counts as without rare shingles, and what it holds
    # twice as held by more, which only loosens bounds
    mine = sets.join(loose, "id", "left_semi").dropDuplicates(["id", "shingles"])
    several = mine.groupBy("id").agg(F.min(F.xxhash64("shingles")).alias("least"), F.max(F.xxhash64("shingles")).alias("most")).where("least < most").select("id")
    held = mine.mapInArrow(values(decode), "value long, id long")
    few = held.groupBy("value").agg(F.count("*").alias("holders")).where(F.col("holders") <= RARE)
    rare = cut(held.join(few, "value"))
    common = cut(loose.join(rare.groupBy("id").agg(F.count("*").alias("rare")).join(several, "id", "left_anti"), "id", "left").select("id", "n", "label", F.coalesce("rare", F.lit(0)).alias("rare")))
    bits = cut(mine.mapInArrow(cells(decode), f"id long, {', '.join(f'{w} long' for w in WORDS)}").join(several, "id", "left_anti"))
    # what two sets share is the rare shingles counted here and at most all others of the smaller part, so few pairs need their sets
    fits = f"100 * (least(shared, shared_x) + together) >= {percent} * (n + n_x - least(shared, shared_x) - together)"
    member = F.struct("label", "id", "n", (F.col("n") - F.col("rare")).alias("shared"))
    holders = rare.where("holders > 1").select("value", "id").join(sent(common), "id").groupBy("value").agg(F.sort_array(F.collect_set(member)).alias("those"))
    groups = holders.where("those[0].label < element_at(those, -1).label").groupBy("those").agg(F.count("*").alias("times"))
    pairs = groups.select("those", "times", F.explode("those").alias("x")).select("x", "times", F.explode(F.expr(f"filter(those, m -> m.label > x.label and 100 * least(m.n, x.n) >= {percent} * greatest(m.n, x.n))")).alias("y"))
    pairs = pairs.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("x.n").alias("n_x"), F.col("y.n").alias("n"), F.col("x.shared").alias("shared_x"), F.col("y.shared").alias("shared")).agg(F.sum("times").alias("together"))
    labels = grown(labels, pairs.where(fits).select("x", "y"))

    pivots = SMALL
    # no rare shingle in common, and a cell that only one of two sets fills holds a shingle that the other lacks
    apart = " + ".join(f"bit_count({w} ^ {w}_x)" for w in WORDS)
    fits = f"100 * least(shared, shared_x) >= {percent} * (n + n_x - least(shared, shared_x)) and (not (known and known_x) or {100 + percent} * (n + n_x - ({apart})) >= {2 * percent} * (n + n_x))"
    pivots = SMALL
    open_ = opened(open_, labels)
    while True:
        rows_ = open_.join(common.select("id", "rare"), "id").join(bits, "id", "left").withColumn("shared", F.col("n") - F.col("rare"))
        rows_ = rows_.withColumn("known", F.col(WORDS[0]).isNotNull()).withColumns({w: F.coalesce(w, F.lit(0)) for w in WORDS})
        chance = (F.xxhash64("key", "id", F.lit(1)).bitwiseAND((1 << 30) - 1) / (1 << 30)) * F.col("size")
        picked = rows_.where(chance < pivots).where(chance >= (pivots // 8 if pivots > SMALL else 0))
        picked = picked.select("key", F.col("id").alias("x"), *[F.col(c).alias(f"{c}_x") for c in ("n", "shared", "label", "known", *WORDS)])
        pairs = cut(rows_.join(picked, "key").where("label <> label_x").where(fits).select("x", F.col("id").alias("y")))
        open_ = open_.where(F.col("size") > pivots)  # in the others every member has been a pivot
        if pairs.take(1):
            labels = grown(labels, pairs)
            open_ = opened(open_, labels)
        if not open_.take(1):
            return labels
        pivots *= 8
