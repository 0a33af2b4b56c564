"""Repair of conversations by lazy weighted determinisation.

A conversation should read s?(ua)+ in role initials, or be empty. Rows are letters: role initial and fault. Going from the last row to the
first, the least cost to finish from each of four places of that pattern is a vector; less its minimum, it is a state of a deterministic
automaton, of which few exist. Steps (state, letter) -> (state, weight) and the cheapest edits at each are computed when they are first met and then
looked up: the scan adds up weights, which gives the cost; the trace then goes back over the scan, that is from the first row on, along tight arcs, and gives the audit.

Places: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row. The pattern may end in 0 and 3.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseq.llm.merkle import placed
from tallyseq.operators.barcode import small
from tallyseq.operators.common import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
CLEAN, BLANK, DUPLICATE, CUT_OFF = range(4)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # places before and after a row
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}  # what may be inserted or reroled to at a place
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
END, TAIL = (0, 6, 3, 0), ("", "II", "I", "")  # cost and edits from each place to the end of the pattern
VISIBLE, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
SLICE = 4096
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def letter(role: str, fault: int) -> str:
    """One of A to P for a role's initial and a row's fault."""
    return chr(65 + 4 * fault + ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3))


def initial(code: str) -> str:
    return "sua-"[(ord(code) - 65) % 4]


class Automaton:
    """States are cost vectors less their minimum; steps and edits are filled in as they are met."""

    def __init__(self) -> None:
        self.vectors, self.states = [END], {END: 0}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.edits: dict[tuple[int, str, int], tuple[str, int]] = {}

    def ways(self, state: int, code: str, place: int) -> Iterator[tuple[int, str, int]]:
        """(cost to the end, edits, next place) of the ways over a row from a place: up to two rows inserted, then it is kept, reroled or deleted."""
        after, fault, role = self.vectors[state], (ord(code) - 65) // 4, initial(code)
        more = TRUNCATED if fault == CUT_OFF else 0
        for inserted in range(3):
            cost, edits = INSERT * inserted, "I" * inserted
            yield cost + DELETE + after[place], f"{edits}D", place
            if fault not in (BLANK, DUPLICATE):
                if (to := NEXT.get(role, {}).get(place)) is not None:
                    yield cost + KEEP + more + after[to], f"{edits}K", to
                to = NEXT[WANTED[place]][place]
                yield cost + REROLE + more + after[to], f"{edits}R", to
            place = NEXT[WANTED[place]][place]

    def step(self, state: int, code: str) -> tuple[int, int]:
        """State before a row, and what the least cost has grown by."""
        if (known := self.steps.get((state, code))) is None:
            found = [min(self.ways(state, code, place)) for place in range(4)]
            low = min(cost for cost, _, _ in found)
            vector = tuple(cost - low for cost, _, _ in found)
            if vector not in self.states:
                self.states[vector] = len(self.vectors)
                self.vectors.append(vector)
            for place, (_, edits, to) in enumerate(found):  # the least cost, of equals the edits that come first in ASCII
                self.edits[state, code, place] = edits, to
            known = self.steps[state, code] = self.states[vector], low
        return known

    def solve(self, codes: str) -> tuple[int, list[tuple[str, int]]]:
        """Least cost, and the edits at each row with the place before it; the edits after the last row come last."""
        state, total, path = 0, 0, []
        for code in reversed(codes):
            path.append(state)
            state, weight = self.step(state, code)
            total += weight
        place, edits = 0, []
        for code, after in zip(codes, reversed(path), strict=True):
            made, to = self.edits[after, code, place]
            edits.append((made, place))
            place = to
        return total + self.vectors[state][0], [*edits, (TAIL[place], place)]


AUTOMATON = Automaton()


def summary(codes: str) -> tuple[list[int], list[tuple[str, int]]]:
    """blank, duplicate, truncated, illegal and cost of the letters of a conversation, and its edits (see Automaton.solve())."""
    faults = [(ord(c) - 65) // 4 for c in codes]
    roles = [initial(c) for c in codes]
    illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    cost, edits = AUTOMATON.solve(codes)
    return [*(faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)), illegal, cost], edits


def lines(rows: list[tuple[str, str]], edits: str, place: int) -> tuple[list[str], int]:
    """role:text of what is left of (role, text) rows after ``edits`` from a place of the pattern, and the place behind them."""
    out, at = [], 0
    for e in edits:
        if e in "KRD":
            role, text = rows[at]
            at += 1
        if e == "D":
            continue
        if e == "K":
            out.append(f"{role}:{text}")
            place = NEXT[role[0]][place]
        else:
            out.append(f"{ROLES[WANTED[place]]}:{text if e == 'R' else ''}")
            place = NEXT[WANTED[place]][place]
    return out, place


def fault_of(text: str, seen: bool) -> int:
    if not VISIBLE.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return CLEAN if LAST.search(text)[0] in ".!?" else CUT_OFF


def repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """OUT and repaired_sha256 of one conversation."""
    seen: set[tuple[str, str]] = set()
    codes = []
    for role, text in rows:
        codes.append(letter(role, fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    counts, edits = summary("".join(codes))
    audit = "".join(made for made, _ in edits)
    return gaps, *counts, audit, hashlib.sha256("\n".join(lines(rows, audit, 0)[0]).encode()).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, dropped of ``conversations(conv_id, turn, role, text)`` with faults put in.

    By crc32(conv_id:turn) % 20: 0 the row is dropped (it stays, as a mark), 1 its text is emptied, 2 loses its . ! ?, 3 it stands twice, 4 its role is
    user. A null conv_id or turn counts as one space in that sum, a null role or text becomes one space.
    """
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return given.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (kind == 0).alias("dropped"))


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over sorted rows: each conversation of the partition; one conversation is held at a time."""
    out: list[tuple] = []
    current, turns, rows = (), [], []
    for b in batches:
        for conv, turn, role, text, gone in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped")], strict=True):
            if current != (conv,):
                if current:
                    out.append((*current, *repaired(turns, rows)))
                current, turns, rows = (conv,), [], []
            if not gone:
                turns.append(turn)
                rows.append((role, text))
        if len(out) > 1000:
            yield answers(out)
            out = []
    if current:
        out.append((*current, *repaired(turns, rows)))
    yield answers(out)


FIELDS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def answers(rows: list[tuple], schema: pa.Schema = FIELDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def spread(rows: DataFrame, size: int) -> DataFrame:
    """The same answers for conversations of any length: rows are numbered across partitions and worked on in slices of ``size``.

    Only one letter a row and then the repaired text, as a stream, meet in one task for each conversation: the audit is one value, and
    a hash cannot be split.
    """
    marked = rows.withColumn("mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    numbered = placed(marked, "conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mark").asc()).withColumn("slice", F.floor(F.col("pos") / size))
    fresh = numbered.groupBy("conv_id", "mark").agg(F.min("pos").alias("first_pos")).select(F.col("conv_id").alias("first_conv"), "first_pos")
    told = numbered.join(fresh, same("conv_id", "first_conv") & (F.col("pos") == F.col("first_pos")), "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("first_pos").isNull(), DUPLICATE).when(last.isin(*".!?"), CLEAN).otherwise(CUT_OFF)
    place = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    role = F.when((F.length("role") > 0) & (place > 0), place - 1).otherwise(3)
    code = F.chr((65 + 4 * fault + role).cast("long"))
    slices = told.groupBy("conv_id", "slice").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))), lambda x: x["code"]), "").alias("codes"))
    turns = numbered.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))

    def conversation(t: pa.Table) -> pa.Table:
        parts = sorted(zip(t.column("slice").to_pylist(), t.column("codes").to_pylist(), strict=True))
        counts, edits = summary("".join(c for _, c in parts))
        made, at = [], 0
        for k, codes in parts:
            to = at + len(codes) + (k == parts[-1][0])
            made.append((t.column("conv_id")[0].as_py(), k, "".join(e for e, _ in edits[at:to]), edits[at][1], *counts))
            at = to
        return pa.Table.from_batches([answers(made, AUDITS)])

    audits = cut(slices.groupBy("conv_id").applyInArrow(conversation, "conv_id long, slice long, edits string, place long, blank long, duplicate long, truncated long, illegal long, cost long"))

    def slice_lines(t: pa.Table, a: pa.Table) -> pa.Table:
        order = t.sort_by("pos")
        pairs = list(zip(order.column("role").to_pylist(), order.column("text").to_pylist(), strict=True))
        text = "\n".join(lines(pairs, a.column("edits")[0].as_py(), a.column("place")[0].as_py())[0])
        return pa.table([a.column("conv_id"), a.column("slice"), pa.array([text])], names=["conv_id", "slice", "text"])

    pieces = numbered.select("conv_id", "slice", "pos", "role", "text").groupBy("conv_id", "slice").cogroup(audits.select("conv_id", "slice", "edits", "place").groupBy("conv_id", "slice")).applyInArrow(slice_lines, "conv_id long, slice long, text string")
    hashes = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "slice").mapInArrow(hashed, "hash_conv long, repaired_sha256 string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "edits"))), lambda x: x["edits"]), "")
    whole_audits = audits.groupBy("conv_id").agg(joined.alias("audit"), *[F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    out = whole_audits.join(turns.withColumnRenamed("conv_id", "turns_conv"), same("conv_id", "turns_conv")).join(hashes, same("conv_id", "hash_conv"))
    return out.select(*FIELDS.names)


AUDITS = pa.schema([("conv_id", pa.int64()), ("slice", pa.int64()), ("edits", pa.string()), *[(c, pa.int64()) for c in ("place", "blank", "duplicate", "truncated", "illegal", "cost")]])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: sha256 over the pieces of each conversation, in order, as a stream."""
    current, state, begun, out = (), None, False, []
    for b in batches:
        for conv, text in zip(b.column("conv_id").to_pylist(), b.column("text"), strict=True):
            if current != (conv,):
                if current:
                    out.append((*current, state.hexdigest()))
                current, state, begun = (conv,), hashlib.sha256(), False
            if piece := text.as_py():
                state.update((b"\n" if begun else b"") + piece.encode())
                begun = True
    if current:
        out.append((*current, state.hexdigest()))
    yield answers(out, pa.schema([("hash_conv", pa.int64()), ("repaired_sha256", pa.string())]))


def repair(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """One row for each conv_id of ``rows(conv_id, turn, role, text, copy, dropped)`` (see damaged()): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows of a conversation go by turn (nulls first), then role and text. Conversations of at most ``size`` rows are held one at a time, longer
    ones are worked on in slices (see spread()). A null conv_id is a conversation of its own. All rows dropped: zeros, an empty
    audit and the hash of nothing. Empty and blank texts are faults, very long ones rows like any other, repeated rows duplicates. Empty table: no rows. Ties of cost: the edits that come first in ASCII.
    """
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("held")).where(F.col("held") > size)
    large = cut(counts.select(F.col("conv_id").alias("large_conv")))
    fits, long_ones = rows, None
    if large.take(1):
        met = same("conv_id", "large_conv")
        fits, long_ones = rows.join(small(large), met, "left_anti"), rows.join(small(large), met, "left_semi").where("not dropped").drop("dropped")
    ordered = fits.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy").select("conv_id", "turn", "role", "text", "dropped")
    out = ordered.mapInArrow(whole, f"conv_id long, {OUT}, repaired_sha256 string")
    if long_ones is None:
        return out
    found = spread(long_ones, size)
    every = large.join(found, same("large_conv", "conv_id"), "left").select(F.col("large_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in FIELDS.names[1:7]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
    return out.unionByName(every)
