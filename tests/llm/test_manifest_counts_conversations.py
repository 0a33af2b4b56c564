"""Token counts against the library, the Merkle manifest and the repair of conversations against plain versions."""

import random
import zlib

import public_tokenizers
import pytest
import sentencepiece

from tallyseq.llm import conversations, merkle, token_counts
from tests.llm import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string, copy string, dropped string, pos int, tree string"


def test_token_counts_are_those_of_the_library(spark, table, odd, corpus):
    rng = random.Random(1)
    alphabet = list("aeiouthnsr  \n▁éß☃漢字😀.,;!0123456789\0")
    texts = ["", " ", "  a", "x" * 20_000, "ab" * 9_000, "▁▁ a ▁", "<s> <0x0A> </s>", "ﬁ Ａ　b", *["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]]
    docs = [*odd, *corpus.items(), *enumerate(texts, 1000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t in docs)
    got = token_counts.count_tokens(table(docs), MODEL, 50)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert token_counts.count_tokens(table({}), MODEL).collect() == []


def test_cuts_only_where_no_piece_crosses():
    merger = token_counts.Merger(MODEL)
    assert merger.parts("▁a▁▁b▁") == ["▁a", "▁▁b", "▁"]
    assert merger.merged("") == 0 and merger.merged("▁") == 1 and merger.merged("\U0010fffd") == 4


def manifest_rows(n, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xy"), rng.choice(["en", "en", "en", "é", None, "a b", ""]), rng.randint(0, 9), rng.choice(["Some Text", "plain", "", None, "ÄÖ ü"])) for i in range(n)]
    return [*rows, (None, None, None, None, None), (None, None, "en", None, None), (5, "x", "en", 1, "Again"), (5, "x", "en", 1, "Again"), (6, "x", "lonely", 1, "T" * 50_000)]


@pytest.mark.parametrize("n", [0, 7, 600, 5000])
def test_manifest(spark, n):
    """One, two and three rounds of buckets; nulls in every column, equal rows, a group of one, a long text, columns of clashing names."""
    rows = manifest_rows(n)
    docs = spark.createDataFrame([(*r, "t", 1, "h", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, h string, n int")
    got = merkle.digest(merkle.manifest(docs, merkle.lower_cased())).collect()
    want = brute.merkle(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([key((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"])) for r in got]) == sorted(map(key, want))
    assert all(r["folded_root"] == r["root"] for r in got if r["verified"])


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.digest(merkle.manifest(docs)).collect() == []


def test_whole_proofs_lead_to_the_root(spark):
    """The operator's own output: places and neighbours at each level, without tampering."""
    docs = spark.createDataFrame(manifest_rows(100), "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle.manifest(docs).collect():
        h = r["leaf"]
        for p in r["proof"]:
            h = brute.sha(p["others"][: 64 * p["place"]] + h + p["others"][64 * p["place"] :])
        assert h == r["root"] and r["leaf"] == r["touched"]


def test_automaton_against_cheapest_paths():
    rng = random.Random(3)
    for _ in range(1500):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 7))]
        cost, edits = conversations.AUTOMATON.solve("".join(conversations.letter(r, f) for r, f in rows))
        assert (cost, "".join(e for e, _ in edits)) == brute.cheapest_edits(rows), rows
    assert len(conversations.AUTOMATON.vectors) < 100  # states and steps are shared by all conversations


def turns(seed=4, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t", "é. ", "x" * 30_000 + ".", None, "Done.\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hello."), (3, None, None, None), (3, None, "user", "Yes."), (9, 1, "user", "Yes."), (9, 1, "user", "Yes.")]
    drop = next(t for t in range(1000) if zlib.crc32(f"777:{t}".encode()) % 20 == 0)
    return [*rows, (777, drop, "user", "gone")]


@pytest.mark.parametrize("size", [4096, 4, 2])
def test_repair_of_conversations(spark, size):
    """Held whole, and in slices of four and of two rows."""
    rows = turns()
    given = spark.createDataFrame([(*r, "c", "d", 1, "t") for r in rows], TURNS)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(given), size).collect()}
    want = brute.repaired_conversations(rows)
    assert got == want
    assert got[777] == (0, 0, 0, 0, 0, 0, "", brute.sha("")) and conversations.repair(conversations.damaged(given.limit(0)), size).collect() == []


def test_one_conversation_holds_most_rows(spark):
    """A conversation of many slices, with one row that repeats a thousand times."""
    rows = [(1, t, ("user", "assistant")[t % 2], "Again." if t % 3 else f"Text {t}.") for t in range(3000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {r["conv_id"]: tuple(r) for r in conversations.repair(conversations.damaged(given)).collect()}
    assert {r["conv_id"]: tuple(r) for r in conversations.repair(conversations.damaged(given), 64).collect()} == whole
    assert whole[1][3] > 1500
