"""A hard delete stores its graph once."""

from lorekeep.operators import graph
from lorekeep.plans import catalog

SF = "/root/testdata/sf0.001"


def reads(frame, table):
    return any(f"/{table}.parquet" in f for f in frame.inputFiles())


def test_hard_delete_stores_its_graph_once(spark):
    left = catalog.QUERIES["hard_delete"](spark, SF)
    assert not reads(left, "lineitem") and not reads(left, "orders")


def test_deletion_of_nested_documents(spark):
    edges = spark.createDataFrame([("s1", "d1", "PROVIDES"), ("s1", "d1", "PROVIDES"), ("s2", "d1", "PROVIDES"), ("s2", "d9", "PROVIDES"), ("d1", "d2", "CONTAINS"), ("d2", "c1", "CONTAINS"),
                                   ("c1", "c2", "CONTAINS"), ("c2", "d1", "CONTAINS"), ("d9", "c9", "CONTAINS"), ("a1", "c2", "SUPPORTED_BY"), ("a1", "d2", "SUPPORTED_BY"), ("a9", "c9", "SUPPORTED_BY")],
                                  "src string, dst string, relation string")
    gone = graph.deletion_closure(edges, spark.createDataFrame([("d1",), ("d2",), ("d7",)], "document_id string"))
    assert sorted(r.id for r in gone.collect()) == ["a1", "c1", "c2", "d1", "d2", "d7", "s1"]
