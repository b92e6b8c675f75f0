"""What signatures of the shingle join take on their way, and sets that go by one name."""

import numpy as np

from lorekeep.llm import ngram_join
from tests.llm.test_ngram_join import check, variants


def entries(sets, each, seed=3):
    rng = np.random.default_rng(seed)
    entry = np.zeros(sets * each, ngram_join.ENTRY)
    entry["doc"] = np.repeat(np.sort(rng.integers(0, 2**48, sets)), each)
    entry["set"] = entry["doc"]
    entry["sig"] = rng.integers(0, 2**24, len(entry), dtype=np.uint64) << np.uint64(24)
    entry["part"] = rng.integers(0, 200, len(entry))
    return entry


def test_bytes_of_an_entry():
    """Where buckets are many, each holds one entry of a set: its name, 24 bits of the signature, the part and little else."""
    for sets, each, most in ((2000, 1, 11.5), (75, 1, 11.8), (1600, 3, 7)):
        entry = entries(sets, each)
        blob = ngram_join._packed(entry)
        assert len(blob) <= most * len(entry)
        got = ngram_join._unpacked(blob)
        assert all((got[c] == entry[c]).all() for c in ("doc", "set", "part", "hot")) and (got["sig"] == entry["sig"] >> np.uint64(24)).all()


def test_other_names_survive():
    for names in (0, 7):
        entry = entries(20, 2)
        entry["set"] = names
        assert (ngram_join._unpacked(ngram_join._packed(entry))["set"] == names).all()


def test_sets_of_one_name(spark, monkeypatch):
    """Seven bits make different sets share names; all of them are asked, on both passes."""
    rows = list(enumerate([*variants(30, 40, 3, 1), *variants(25, 60, 3, 2), *variants(5, 200, 8, 3), *(f"x{i} y{i} z{i}" for i in range(60))]))
    monkeypatch.setattr(ngram_join, "NAME", (1 << 7) - 1)
    check(spark, rows)
    monkeypatch.setattr(ngram_join, "CROWD", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    check(spark, rows)


def test_texts_not_asked_for_do_not_move(spark, monkeypatch):
    """All asked rows stay, of the others about one in eight; a table that is too small for its ids only lets more through."""
    rows = spark.range(20_000).selectExpr("id", "repeat('x', int(id % 3)) AS text")
    ids = spark.range(0, 20_000, 40)
    kept = {r.id for r in ngram_join.likely_rows(rows, ids, 500).collect()}
    assert kept >= set(range(0, 20_000, 40)) and len(kept) <= 500 + 19_500 / 5
    monkeypatch.setattr(ngram_join, "MOST_SLOTS", 7)
    assert {r.id for r in ngram_join.likely_rows(rows, ids, 500).collect()} >= set(range(0, 20_000, 40))
    assert ngram_join.likely_rows(rows, ids.where("id < 0"), 0).collect() == []


def test_linked_pairs_shuffles_no_unasked_text(spark):
    """Without small sides to broadcast, the texts that the check of pairs shuffles are those it asks for."""
    docs = spark.range(0, 4000).selectExpr("id", "concat('a b c d e f', id) AS text")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        close = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)], "a long, b long")
        linked = ngram_join.linked_pairs(docs, close, 5, 20)
        plan = linked._jdf.queryExecution().executedPlan().toString()
        below = [x.split("Range (")[0] for x in plan.split("BroadcastHashJoin [word") if "getbit" in x.split("\n")[0]]
        assert below and not any("hashpartitioning" in x for x in below)
        assert linked.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
