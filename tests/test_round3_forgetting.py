"""Forgetting reads its input once and counts namers once."""

from lorekeep.operators import forgetting
from lorekeep.plans import catalog

SF = "/root/testdata/sf0.001"


def reads(frame, table):
    return any(f"/{table}.parquet" in f for f in frame.inputFiles())


def test_forgetting_reads_its_input_once(spark):
    assert not reads(catalog.QUERIES["forget_memories"](spark, SF), "lineitem")


def test_namers_are_counted_once(spark, monkeypatch):
    """A chain of names falls link by link; a node named twice falls in the round its second namer does."""
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "b"), ("x", "e"), ("b", "e"), ("d", "f")]
    written, real = [], forgetting.cut_lineage
    def cut(frame):
        out = real(frame)
        written.append((frame.columns, out.count()))
        return out
    monkeypatch.setattr(forgetting, "cut_lineage", cut)
    got = forgetting.fallen(spark.createDataFrame(links, "namer string, named string"), spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r["round"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("f", 4)}
    assert [n for c, n in written if c == ["namer", "named"]] == [7, 4]
