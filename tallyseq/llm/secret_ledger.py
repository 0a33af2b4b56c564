"""Secret scans over a blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger remembers which
rule versions have seen which blob, so a run scans a blob once, and only with the rules
that have not seen it; findings are then joined back to every path that holds the blob. Whether a blob is new is
settled by hashes alone; content moves only where a pending rule may match it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseq.llm.common import cut

BROADCAST_BLOBS = 100_000  # hashes of 64 characters
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hints``: each match contains one of these texts, which are looked for first; none: any text may match. ``version``: raise it when
    the rule changes, so that blobs are scanned again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of hex digits is one match, so short runs need not be listed
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyJ",)),
)


def _may(rule: Rule, text: Column) -> Column:
    """Whether the text holds one of the rule's hints, or the rule has none."""
    return reduce(Column.__or__, [text.contains(h) for h in rule.hints]) if rule.hints else F.lit(True)


def _has(rule: Rule, text: Column) -> Column:
    return _may(rule, text) & F.regexp_like(text, F.lit(rule.pattern))


def _length_of(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))


def _span(i: int, rule: Rule):
    """Function of k: the span of the k-th match of rule ``i``, null if its group is too short."""

    def span(k: Column) -> Column:
        start = _length_of(F.slice(f"gap{i}", 1, k + 1)) + _length_of(F.slice(f"hit{i}", 1, k))
        end = start + F.length(F.get(f"hit{i}", k))
        return F.when(F.length(F.get(f"val{i}", k)) >= rule.least, F.struct(start.alias("start"), F.lit(i).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))

    return span


def _of_rank(i: int) -> Column:
    return F.filter("spans", lambda s: s["rank"] == i)


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``found``: the spans of the rules whose keys are in column ``todo``, by start, rule order and end.

    Offsets count code points, end exclusive. The text between the matches and the matches
    themselves come from split() and regexp_extract_all(); their lengths give the offsets. All rows
    are returned, an empty array where nothing is found.
    """
    text = F.col("content")
    for i, r in enumerate(rules):
        texts = texts.withColumn(f"has{i}", F.array_contains("todo", r.key) & _has(r, text))
    for i, r in enumerate(rules):
        none = F.array().cast("array<string>")
        texts = texts.withColumn(f"hit{i}", F.when(F.col(f"has{i}"), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).otherwise(none))
        texts = texts.withColumn(f"gap{i}", F.when(F.col(f"has{i}"), F.split(text, r.pattern, -1)).otherwise(none))
        texts = texts.withColumn(f"val{i}", F.when(F.col(f"has{i}"), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))).otherwise(none)) if r.group else texts.withColumn(f"val{i}", F.col(f"hit{i}"))
    spans = []
    for i, r in enumerate(rules):
        made = F.filter(F.transform(F.sequence(F.lit(0), F.size(f"hit{i}") - 1), _span(i, r)), lambda x: x.isNotNull())
        spans.append(F.when(F.size(f"hit{i}") > 0, made).otherwise(F.array().cast(SPAN)))
    return texts.withColumn("found", F.array_sort(F.concat(*spans)).cast(SPAN)).drop(*[f"{p}{i}" for p in ("has", "hit", "gap", "val") for i in range(len(rules))])


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for ``versions(content)``, one for each scanned blob, clean ones too: blob, rules (array of rule keys), spans.

    ``ledger``: earlier results of this function. A blob that the ledger holds under all current
    rules gives no row; one that it holds under some is scanned with the others only. Null content is
    scanned as empty. Copies are collapsed before the shuffle, so a content that many paths hold is read
    once for each task. With a ledger, the blobs to scan are found by their hashes; of the others, and of those in which no pending
    rule's hint occurs, the content is not shuffled. Empty table: no rows. Repeated rows are copies. Other columns are ignored.
    """
    content = F.coalesce("content", F.lit(""))
    held = versions.select(F.sha2(content, 256).alias("blob"), content.alias("content"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = held.groupBy("blob").agg(F.first("content").alias("content")).withColumn("todo", keys)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("seen"))
        todo = F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen"))
        fresh = cut(held.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).where("size(todo) > 0"))
        pending = {r["key"] for r in fresh.select(F.explode("todo").alias("key")).distinct().collect()}  # no more than there are rules
        may = reduce(Column.__or__, [_may(r, F.col("content")) for r in rules if r.key in pending], F.lit(False))
        if fresh.count() <= BROADCAST_BLOBS:
            held = held.join(F.broadcast(fresh.select("blob")), "blob", "left_semi")
        blobs = held.select("blob", F.when(may, F.col("content")).alias("content")).groupBy("blob").agg(F.first("content").alias("content")).join(fresh, "blob")
    return find(blobs, rules).select("blob", F.col("todo").alias("rules"), F.col("found").alias("spans"))


def recorded(versions: DataFrame, ledger: DataFrame | None = None, history: tuple[tuple[Rule, ...], ...] = (BASE, RULES)) -> DataFrame:
    """The ledger of ``versions(content)`` after a scan under each rule set of ``history`` in turn; ``ledger`` is what was there before.

    Each scan is stored before the next begins, which so scans only the pairs of blob and rule version that are new. A blob
    may have several rows, which findings() merges. Null, repeated and no rows: as in scan_history().
    """
    for rules in history:
        new = cut(scan_history(versions, ledger, rules))
        ledger = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return ledger


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """``paths(content, ...)`` with ``spans``, an empty array where the ledger has none for the content.

    If the ledger holds several rows for a blob (scanned under new rules later), their spans are merged.
    """
    spans = ledger.where("size(spans) > 0").groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    keyed = paths.drop("spans", "blob").withColumn("blob", F.sha2(F.coalesce("content", F.lit("")), 256)).drop("content")
    return keyed.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs(doc_id, text)``.

    The spans come from a ledger that is filled under the base rules first and then brought up to date under all rules (recorded()).
    Null text counts as empty and has no span; spans that start together stand in the order of the rules; repeated rows each
    get the same answer, null doc_ids too. Empty table: no rows. Other columns are ignored.
    """
    versions = docs.select("doc_id", F.col("text").alias("content"))
    found = findings(versions, recorded(versions))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    n = [F.size(_of_rank(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask`` and n_chars set anew; all rows stay.

    Overlapping spans are masked once, together. A row without a finding is unchanged, so are null and empty texts; repeated rows
    are masked alike. Empty table: no rows. A secret under a null doc_id is masked too.
    """
    columns = docs.columns
    versions = docs.withColumn("content", F.col("text"))
    spans = scan_history(versions).select("blob", F.col("spans").alias("found_spans"))
    keyed = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(spans, "blob", "left")
    merged = F.aggregate(
        F.col("found_spans"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    keyed = keyed.withColumn("cuts", F.when(F.size("found_spans") > 0, merged))
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda s: s["end"]))
    ends = F.concat(F.transform("cuts", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"])), mask)
    text = F.when(F.col("cuts").isNotNull(), kept).otherwise(F.col("text"))
    out = keyed.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out.select(*columns)
