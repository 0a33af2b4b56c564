"""Language ID against Kneser-Ney from its definition: probabilities, choice, score, entropy and rejection."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyseq.llm import language_id
from tests.llm import brute

LETTERS = {"aa": "aeioulmn", "bb": "bdgkrstz", "cc": "aeibdgxy"}


def documents():
    """Twenty texts for each of three languages, some strange ones, and a text in letters that no language has."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word(LETTERS[lang]) for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate(list(LETTERS) * 20)]
    return [*rows, (100, "ωψχ φυτ ωωω " * 8, "aa"), (101, "12 34", "bb"), (102, None, "aa"), (103, "zug " * 3, None), (104, "x" * 90, "cc")]


def test_against_plain_kneser_ney(spark):
    rows, order, widen = documents(), 3, 1.1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    apart = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(1)), F.lit(5)) == 0).collect()}
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    usable = [(i, t, x) for i, t, x in rows if t is not None and x is not None and i not in held]
    models = {x: brute.KneserNey([w for i, t, y in usable if y == x and i not in apart for w in language_id.words_of(t)], order, language_id.EDGE) for x in sorted(LETTERS)}

    def answer(text):
        words = language_id.words_of(text) if text else []
        if not any(map(str.isalpha, text or "")):
            return "und", 0.0, None
        logs = {x: m.log_chance(words) for x, m in models.items()}
        best = max(sorted(logs), key=logs.get)
        return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), -logs[best] / sum(len(w) + 1 for w in words)

    want = {i: answer(t) for i, t, _ in rows}
    limits = {x: widen * max((want[i][2] for i, _, y in usable if i in apart and y == x == want[i][0]), default=math.inf) for x in models}
    got = {r["doc_id"]: r for r in language_id.identify(docs, order=order, widen=widen).collect()}
    for i, text, _ in rows:
        lang, score, entropy = want[i]
        assert got[i]["held_out"] == (i in held) and got[i]["lang_pred"] == lang
        assert got[i]["score"] == pytest.approx(score, abs=1e-4)
        if entropy is not None:
            n = sum(len(w) + 1 for w in language_id.words_of(text))
            assert got[i]["cross_entropy"] == pytest.approx(entropy, rel=1e-4)
            assert got[i]["accepted"] == (entropy <= limits[lang] * (1 + 1 / math.sqrt(n)))
    assert len({got[i]["accepted"] for i in got}) == 2 and not got[100]["accepted"]
    kept = {r["doc_id"] for r in language_id.accepted(docs, order=order, widen=widen).collect()}
    assert kept == {i for i, r in got.items() if r["accepted"]}
