"""Language ID by interpolated Kneser-Ney character models, held in sorted hash arrays."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseq.llm.common import fold, mix64

EDGE = "\x02"
CACHE = 200_000
PIECE = 40


class Model:
    """Probabilities of one character after up to order - 1 others, for each language.

    For order n, ``keys[n]`` holds the sorted hashes of the n-grams seen in any language; row i of ``logp[n]``
    holds their interpolated log probabilities by language (nan where the language has not seen it), and ``back`` the
    log weight that a context leaves to the next lower order (0 where the context is unseen).
    """

    def __init__(self, languages: list[str], order: int) -> None:
        self.languages, self.order = languages, order
        self.keys: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.back: dict[int, np.ndarray] = {}
        self.floor = np.zeros(len(languages), np.float32)
        self.limit = np.full(len(languages), np.inf)


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the rows of a matrix of code points."""
    h = np.full(len(codes), np.uint64(codes.shape[1]))
    for j in range(codes.shape[1]):
        h = mix64(h ^ codes[:, j].astype(np.uint64))
    return h


def fit(grams: list[tuple[str, str, int]], order: int, discount: float = 0.75) -> Model:
    """Model from (language, n-gram of length ``order``, count).

    Lower orders count the distinct characters seen before a gram (Kneser-Ney continuation counts); each order leaves
    ``discount`` of every seen gram to the order below, the lowest to a uniform distribution.
    """
    languages = sorted({g[0] for g in grams})
    model = Model(languages, order)
    tables: dict[int, dict[str, dict[int, float]]] = {n: defaultdict(dict) for n in range(1, order + 1)}
    weights: dict[int, dict[str, dict[int, float]]] = {n: defaultdict(dict) for n in range(1, order + 1)}
    for k, language in enumerate(languages):
        counts: dict[int, Counter] = {order: Counter()}
        for lang, g, c in grams:
            if lang == language:
                counts[order][g] += c
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        size = len(counts[1]) + 1
        model.floor[k] = np.log(1 / size)
        lower = defaultdict(lambda size=size: 1 / size)
        for n in range(1, order + 1):
            total, kinds = Counter(), Counter()
            for g, c in counts[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            now = {}
            for g, c in counts[n].items():
                ctx = g[:-1]
                now[g] = max(c - discount, 0) / total[ctx] + discount * kinds[ctx] / total[ctx] * lower[g[1:]]
                tables[n][g][k] = np.log(now[g])
            for ctx in total:
                weights[n][ctx][k] = np.log(discount * kinds[ctx] / total[ctx])
            lower = now
    for source, keys, values, empty, cut in ((tables, model.keys, model.logp, np.nan, 0), (weights, model.contexts, model.back, 0.0, 1)):
        for n in range(1, order + 1):
            names = list(source[n])
            rows = np.full((len(names), len(languages)), empty, np.float32)
            for i, g in enumerate(names):
                for k, v in source[n][g].items():
                    rows[i, k] = v
            codes = np.array([[ord(x) for x in g] for g in names], np.uint32).reshape(len(names), n - cut)
            h = gram_hash(codes)
            by = np.argsort(h)
            keys[n], values[n] = h[by], rows[by]
    return model


def look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted hash, -1 where it is absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def score_characters(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each character and end of the words, by language; and the number of rows of each word."""
    pad = model.order - 1
    text = "".join(EDGE * pad + w + EDGE for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths + pad) - (lengths + pad)
    first = np.repeat(starts + pad - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    out = np.zeros((len(first), len(model.languages)), np.float32)
    open_ = np.ones(out.shape, bool)
    for n in range(model.order, 0, -1):
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        window = codes[first[rows][:, None] + np.arange(1 - n, 1)]
        at = look_up(model.keys[n], gram_hash(window))
        value = np.where(at[:, None] >= 0, model.logp[n][at] if len(model.logp[n]) else np.nan, np.nan)
        hit = open_[rows] & ~np.isnan(value)
        ctx = look_up(model.contexts[n], gram_hash(window[:, :-1]))
        back = np.where(ctx[:, None] >= 0, model.back[n][ctx], 0)
        out[rows] += np.where(hit, value, np.where(open_[rows], back, 0))
        open_[rows] &= ~hit
    out += np.where(open_, model.floor, 0)
    return out, lengths


def score_words(model: Model, words: list[str]) -> np.ndarray:
    """Log probability of each word and its end, by language."""
    out, lengths = score_characters(model, words)
    return np.add.reduceat(out, np.cumsum(lengths) - lengths, axis=0)


def words_of(text: str) -> list[str]:
    """Lower-cased words, cut every PIECE characters so that one endless word needs no long row."""
    words = text.lower().split()
    return words if max(map(len, words), default=0) <= PIECE else [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


class Scorer:
    """Scores texts with one model, remembering up to CACHE distinct words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)), np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """lang_pred, score, cross_entropy, accepted of each text."""
        model, out = self.model, []
        split = [words_of(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known, self.table = {}, self.table[:0]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.known))
        if new and model.languages:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, score_words(model, new)])
        for text, ws in zip(texts, split, strict=True):
            if not ws or not model.languages or not any(map(str.isalpha, text)):
                out.append(("und", 0.0, None, False))
                continue
            n = sum(map(len, ws)) + len(ws)
            total = self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
            best = int(np.argmax(total))
            entropy = -float(total[best]) / n
            out.append((model.languages[best], 1 / float(np.exp(np.maximum(total - total[best], -700)).sum()), entropy, bool(entropy <= model.limit[best] * (1 + 1 / np.sqrt(n)))))
        return out


def predicted(shared):
    """mapInArrow function: the prediction of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            rows = [r for at in range(0, b.num_rows, 512) for r in scorer(b.column("text").slice(at, 512).to_pylist())]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("held_out"), *columns], ["doc_id", "lang", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

    return run


def passing(shared):
    """mapInArrow function: the rows whose text is accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            good = [r[3] for at in range(0, b.num_rows, 512) for r in scorer(b.column("text").slice(at, 512).to_pylist())]
            yield b.filter(pa.array(good, pa.bool_()))

    return run


SCHEMA = "doc_id long, lang string, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean"


def word_grams(order: int):
    """mapInArrow function: (lang, text) to the n-grams of its words, counted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                words.update((lang, w) for w in words_of(text.as_py()))
            counts: Counter = Counter()
            for (lang, w), c in words.items():
                s = EDGE * (order - 1) + w + EDGE
                for i in range(len(s) - order + 1):
                    counts[lang, s[i : i + order]] += c
            rows = [(lang, g, c) for (lang, g), c in counts.items()]
            yield pa.RecordBatch.from_pylist([{"lang": x, "gram": g, "n": c} for x, g, c in rows], pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    return run


def train(labelled: DataFrame, order: int = 5, most: int = 1500, widen: float = 1.4) -> Model:
    """Model from ``labelled(doc_id, text, lang)``, fitted on a bounded sample.

    About ``most`` documents of each language (all, if fewer), chosen by a hash of doc_id, are read whole; every n-gram counts. A fifth of
    them, chosen by another hash, is kept out of the fit and calibrates rejection: a language's limit is
    ``widen`` times the 99.9 % quantile of the cross-entropy of its own documents there (no limit, if there are none).
    """
    spark = labelled.sparkSession
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(share)
    known = F.coalesce("doc_id", F.lit(0))
    unit = F.xxhash64(known).bitwiseAND((1 << 30) - 1) / (1 << 30)
    sample, apart = usable.where(unit < share), F.pmod(F.xxhash64(known, F.lit(1)), F.lit(5)) == 0
    grams = sample.where(~apart).mapInArrow(word_grams(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = fit([(r["lang"], r["gram"], r["n"]) for r in grams.toLocalIterator()], order)
    if not model.languages:
        return model
    scored = sample.where(apart).withColumn("held_out", F.lit(False)).select("doc_id", "lang", "held_out", "text").mapInArrow(predicted(spark.sparkContext.broadcast(model)), SCHEMA)
    for r in scored.where("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("cross_entropy", 0.999, 10_000).alias("q")).collect():
        model.limit[model.languages.index(r["lang"])] = widen * r["q"]
    return model


def identify(docs: DataFrame, folds: int = 3, held: int = 1, **settings) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred, score, cross_entropy, accepted.

    Learns from the documents whose crc32(doc_id) modulo ``folds`` is not ``held`` and which have text and lang. Each word is
    scored as a sequence of characters with its end; a text's cross-entropy is per character. lang_pred: the language with
    the lowest. score: its share of the probability under equal priors. accepted: the cross-entropy is within the language's limit, wider for short texts.

    Null text, or no letter in it: lang_pred ``und``, score 0, not accepted. Null lang only matters for learning; a null
    doc_id counts as not held out. Ties: the first language by name. Nothing to learn from: all ``und``. Repeated rows each get the same
    answer. Empty table: no rows. Other columns are ignored.
    """
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", held_out.alias("held_out"), "text")
    model = train(rows.where("not held_out").select("doc_id", "text", "lang"), **settings)
    return rows.mapInArrow(predicted(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA).drop("lang")


def accepted(docs: DataFrame, folds: int = 3, held: int = 1, **settings) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` that identify() accepts, with the model it would train; columns as they were."""
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    model = train(docs.where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), **settings)
    return docs.mapInArrow(passing(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
