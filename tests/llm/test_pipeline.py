"""Rows of the pipeline's stages against brute force."""

import corpus_pipeline
from tests.llm import brute

STAGES = dict(corpus_pipeline.STAGES)


def planted(changes):
    """Pairs of texts of 100 shingles; ``changes`` single words of the second differ, each in five shingles of its own."""
    docs = {}
    for k, n in enumerate(changes):
        w = [f"p{k}w{i}" for i in range(104)]
        docs[1000 + 2 * k] = " ".join(w)
        for i in range(n):
            w[10 + 10 * i] = f"p{k}new{i}"
        docs[1001 + 2 * k] = " ".join(w)
    return docs


def test_near_stage_links_from_four_fifths(spark, table, corpus):
    """Planted similarities of 0.90, 0.82 (twice) and 0.74."""
    docs = dict(corpus) | planted([1, 2, 2, 3])
    pairs = [(1002, 1003), (1004, 1005)]
    for a, b in pairs:
        x, y = brute.shingles(docs[a]), brute.shingles(docs[b])
        assert 0.80 <= len(x & y) / len(x | y) < 0.85
    got = sorted(r["doc_id"] for r in STAGES["minhash_dedup"](spark, table(docs), "").collect())
    assert got == sorted({c for _, c in brute.near_documents(docs, percent=80).values()})
    assert not {b for _, b in pairs} & set(got) and {1006, 1007} <= set(got)


def test_rows_from_lines_to_packing(spark, table, corpus, tmp_path):
    docs = dict(corpus) | planted([1, 2, 2, 3])
    thin = {i: t for i, t in brute.thin_lines(docs).items() if t == docs[i] or any(x.strip(" \t\n\v\f\r") for x in t.split("\n"))}
    want = {c for _, c in brute.near_documents(thin, percent=80).values()}
    rows = table(docs)
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, rows, "").write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in rows.collect()} == thin
        elif name == "minhash_dedup":
            assert {r["doc_id"]: r["text"] for r in rows.collect()} == {i: thin[i] for i in want}
        elif name == "secret_ledger":
            clear = {r["doc_id"]: r["text"] for r in rows.collect()}
            assert set(clear) == want and all((clear[i] == thin[i]) == (not brute.secrets(thin[i])) for i in want)
    tokens = dict.fromkeys(want, 0)
    for r in rows.collect():
        tokens[r["doc_id"]] += r["n_tokens"]
    assert tokens == {i: len(brute.words(clear[i])) for i in want}


def test_run_over_a_folder(spark, table, corpus, tmp_path):
    """The whole pipeline from a documents table, as the query runs it."""
    docs = [(i, t) for i, t in corpus.items()] + [(500, corpus[1]), (501, None), (502, "12 34 !!!"), (None, corpus[2])]
    table(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "batch_id", "n_tokens"} <= set(rows[0].asDict())
    ids = {r["doc_id"] for r in rows}
    assert ids and ids <= {i for i, _ in docs} and not ids & {501, 502}
    step = table(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(map(str, rows)) == sorted(map(str, step.collect()))
