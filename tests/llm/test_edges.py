"""Nulls, empty tables, blank and very long texts, repeated rows, columns with clashing names."""

import public_tokenizers
import pytest

import corpus_pipeline
from tallyseq.llm import bloom_lm, bpe, language_id, line_dedup, minhash_dedup, packing, quality_rules, recompression, secret_ledger

OPERATORS = {
    "near": minhash_dedup.near_duplicates,
    "lm": bloom_lm.score,
    "language": language_id.identify,
    "repeats": recompression.without_repeats,
    "pack": packing.pack,
    "lines": line_dedup.without_repeated_lines,
    "secrets": secret_ledger.digest,
    "bpe": lambda docs: bpe.digest(bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))),
    "quality": lambda docs: quality_rules.quality(docs, docs.select("doc_id").limit(0)),
}


@pytest.fixture(scope="module")
def answers(table, odd):
    docs = table(odd)
    return {name: f(docs).collect() for name, f in OPERATORS.items()}


def one(answers, name, i):
    rows = [r for r in answers[name] if r["doc_id"] == i]
    assert rows
    return rows[0]


@pytest.mark.parametrize("name", OPERATORS)
def test_all_rows_come_back(answers, odd, name):
    want = sorted((-1 if i is None else i) for i, _ in odd)
    got = sorted({(-1 if r["doc_id"] is None else r["doc_id"]) for r in answers[name]}) if name == "pack" else sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in answers[name])
    assert got == (sorted(set(want)) if name == "pack" else want)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(table, name):
    assert OPERATORS[name](table({})).collect() == []


def test_defined_results(answers):
    near = {i: one(answers, "near", i) for i in (1, 2, 3, 4, 5, 6, 7, 8)}
    assert [near[i]["component_id"] for i in near] == [1, 2, 3, 4, 5, 5, 7, 7] and near[1]["n_shingles"] == near[3]["n_shingles"] == 0
    assert one(answers, "near", None)["component_id"] is None and one(answers, "near", None)["kept"] is False
    assert [one(answers, "lm", i)["n_tokens"] for i in (1, 2, 3, 4)] == [1, 1, 1, 2]
    assert {one(answers, "language", i)["lang_pred"] for i in (1, 2, 3, 9)} == {"und"}
    assert one(answers, "repeats", 8)["n_removed"] == 60_000 and one(answers, "repeats", 7)["n_removed"] == 0
    assert one(answers, "repeats", 1)["kept"] == ""
    assert one(answers, "pack", 1)["batch_id"] is None and one(answers, "pack", 1)["n_tokens"] == 0
    assert sum(r["n_tokens"] for r in answers["pack"] if r["doc_id"] == 7) == 60_000
    assert one(answers, "lines", 1)["text"] is None and one(answers, "lines", 3)["text"] == " \t\n "
    assert sorted(r["text"] for r in answers["lines"] if r["doc_id"] in (5, 6)) == ["", "", "a b c d e f g"]
    assert one(answers, "lines", None)["text"] == "some words without an id here"
    assert one(answers, "secrets", 1)["spans"] == "" and one(answers, "bpe", 1)["n_tokens"] == 0
    assert one(answers, "quality", 1)["base_failed"] and one(answers, "quality", 1)["llr"] is None


def test_pipeline_stages_keep_columns(spark, table, odd, corpus, tmp_path):
    docs = table(odd + [(i + 100, t) for i, t in corpus.items()])
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns, name
    assert docs.count() > 0 and "batch_id" in docs.columns


def test_pipeline_over_an_empty_table(spark, table, tmp_path):
    docs = table({})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
