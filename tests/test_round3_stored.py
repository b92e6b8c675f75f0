"""Recall, exploration and fuzzy resolution make what they read several times once."""

from pyspark.sql import functions as F

from lorekeep.functions.vectors import hash_embedding
from lorekeep.operators import concepts, exploration
from lorekeep.plans import catalog, recall
from lorekeep.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_a_conversation_memory_is_stored(spark):
    for frame in recall.conversation_memory(Tables(spark, SF)):
        assert not any("/conversations.parquet" in f for f in frame.inputFiles())


def test_needs_and_questions_share_one_search(spark, monkeypatch):
    calls, real = [], exploration.hybrid_topk
    monkeypatch.setattr(exploration, "hybrid_topk", lambda nodes, asked, *a, **k: calls.append(asked.count()) or real(nodes, asked, *a, **k))
    none = F.array().cast("array<string>")
    nodes = spark.createDataFrame([("d1", "apple pie"), ("d2", "plum cake"), ("d3", "n:d1 q:7")], "id string, text string").select(
        "id", F.lit("Document").alias("kind"), F.lit("").alias("label"), none.alias("aliases"), "text", F.lit("").alias("summary"), F.lit("").alias("routing_summary"),
        hash_embedding(F.col("text")).alias("embedding"), F.lit(0).alias("hits"), F.lit(True).alias("retrieval_leaf"))
    questions = spark.createDataFrame([(7, "plum cake"), (8, "apple pie")], "query_id long, text string").withColumn("vec", hash_embedding(F.col("text")))
    needs = spark.createDataFrame([(7, "n", 0, "apple"), (8, "n", 0, " Apple PIE")], "query_id long, need_id string, need_no int, description string").withColumn(
        "vec", hash_embedding(F.col("description")))
    provenance = nodes.select(F.col("id").alias("node_id"), F.col("id").alias("document_id"))
    edges = spark.createDataFrame([], "src string, dst string, relation string")
    found = exploration.explore(needs, questions, nodes, edges, provenance)
    best = {(r.need_key, r.node_id): r.score for r in found["branches"].collect()}
    assert calls == [3]
    # Need 7 differs from its question, so it has that one's hit as well; need 8 restates it.
    assert best["7|n", "d2"] > 0.8 and best["7|n", "d1"] > 0.5 and best["8|n", "d1"] > 0.8
    assert {(r.query_id, r.node_id) for r in found["evidence"].collect()} >= {(8, "d1")}


def test_parts_meet_their_vectors_once(spark, monkeypatch):
    seen, real = [], concepts.resolve_with_candidates
    monkeypatch.setattr(concepts, "resolve_with_candidates", lambda *frames: seen.extend(frames) or real(*frames))
    catalog.QUERIES["fuzzy_resolution"](spark, SF)
    assert len(seen) == 2 and not any("/embeddings.parquet" in f for frame in seen for f in frame.inputFiles())
