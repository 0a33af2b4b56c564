"""A run without a ledger fills it for every blob it scanned."""

from tallyseq.llm import secret_ledger


def test_second_run_scans_nothing_again(spark):
    versions = spark.createDataFrame([("a", 1, "token=abcdef"), ("a", 2, "clean"), ("b", 1, "token=abcdef"), ("b", 2, None)], "path string, version int, content string")
    first = secret_ledger.scan_history(versions)
    assert sorted(len(r["spans"]) for r in first.collect()) == [0, 0, 1]
    assert secret_ledger.scan_history(versions, first).count() == 0
    rows = secret_ledger.findings(versions, first).collect()
    assert {(r["path"], r["version"]): len(r["spans"]) for r in rows} == {("a", 1): 1, ("a", 2): 0, ("b", 1): 1, ("b", 2): 0}


def test_history_of_rule_sets(spark, monkeypatch):
    """Older rules, then all: the second scan knows every blob and adds the new rules only; both ways of finding the fresh blobs agree."""
    jwt = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
    versions = spark.createDataFrame([("a", "token=abcdef " + jwt), ("b", "clean"), ("c", "clean"), ("d", None), ("e", jwt)], "path string, content string")
    for most in (0, 1000):
        monkeypatch.setattr(secret_ledger, "BROADCAST_BLOBS", most)
        ledger = secret_ledger.recorded(versions)
        rows = ledger.collect()
        assert len(rows) == 8 and {tuple(r["rules"]) for r in rows} == {tuple(x.key for x in part) for part in (secret_ledger.BASE, secret_ledger.RULES[3:])}
        assert {r["path"]: [s["kind"] for s in r["spans"]] for r in secret_ledger.findings(versions, ledger).collect()} == {"a": ["assign", "jwt"], "b": [], "c": [], "d": [], "e": ["jwt"]}
        assert secret_ledger.scan_history(versions, ledger).count() == 0
        later = versions.unionByName(spark.createDataFrame([("f", "new AKIA" + "A" * 20)], "path string, content string"))
        assert [len(r["spans"]) for r in secret_ledger.scan_history(later, ledger).collect()] == [1]
