"""Whole results and bounded work of the fourth round."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lorekeep import session
from lorekeep.operators import arms, components, concepts, graph, lexical, nearest, sessions, spreading
from lorekeep.plans import catalog
from lorekeep.session import cut_lineage, drop_table
from tests.oracle import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
shared = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not there")


def test_passages_of_one_or_two_words_are_found_like_any_other(spark):
    random.seed(8)
    words = ["ab", "a", "b", "abc", "c a", "é", "ba"]
    texts = {i: random.choice(["", " ", "\n"]) + random.choice([" ", "  ", "\n"]).join(random.choices(words, k=random.randint(0, 9))) for i in range(60)} | {98: None, 99: ""}
    asked = {1: "ab", 2: "b a", 3: "a  b", 4: " abc ", 5: "", 6: " ", 7: None, 8: "é\nab", 9: "ab", 10: "c a b", 11: "zz", 12: "a b ab ba", 13: "b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    passages = spark.createDataFrame(list(asked.items()), "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in lexical.containing(docs, passages).collect())
    expected = sorted((p, d) for p, a in asked.items() for d, t in texts.items() if a is not None and t is not None and a in t)
    assert got == expected and {1, 2, 5, 6, 9} <= {p for p, _ in got}
    only_short = passages.where("item_id in (2, 5)")
    assert sorted((r.item_id, r.doc_id) for r in lexical.containing(docs, only_short).collect()) == [x for x in expected if x[0] in (2, 5)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_concepts_and_queries_do_not_go_through_the_driver(spark):
    # Tables as small as these Spark would broadcast every one.
    held = cut_lineage(spark.createDataFrame([(i, t, i % 2) for i in range(9) for t in ("a", "b")], "id long, term string, in_label int"))
    wanted = cut_lineage(spark.createDataFrame([(q, t) for q in range(4) for t in ("a", "b")], "query_id long, term string"))
    plan = plan_of(concepts._found(wanted, held, 5))
    assert all(f"SortMergeJoin [{key}#" in plan for key in ("id", "query_id", "term"))
    assert "BroadcastHashJoin [id#" not in plan and "BroadcastHashJoin [query_id#" not in plan


def test_names_nodes_inputs_and_blocks_do_not_go_through_the_driver(spark):
    inputs = cut_lineage(spark.createDataFrame([(1, "s", "the red lamp", [1.0, 0.0])], "query_id long, scope string, text string, vec array<double>").withColumn("date", F.lit("2024-02-01").cast("date")))
    names = cut_lineage(spark.createDataFrame([("s", "red lamp", "e1"), ("s", "lamp", "e2")], "scope string, name string, node string"))
    nodes = cut_lineage(spark.createDataFrame([("s", "e1", "entity", "red lamp", [1.0, 0.0]), ("s", "e2", "entity", "lamp", [0.0, 1.0])], "scope string, node string, kind string, label string, vec array<double>")
                        .select("*", F.col("label").alias("text"), F.lit(None).cast("date").alias("date"), *[F.lit(None).cast("string").alias(c) for c in ("state", "source", "session")], F.lit(None).cast("double").alias("confidence")))
    links = cut_lineage(spark.createDataFrame([("e1", "e2", "MENTIONS"), ("e2", "e1", "MENTIONS")], "node string, neighbour string, kind string"))
    named = spreading.named_entities(inputs, names)
    assert "BroadcastHashJoin" not in plan_of(named) and sorted(r.node for r in named.collect()) == ["e1", "e2"]
    active = cut_lineage(named.select("query_id", "node", F.lit(1.0).alias("activation")))
    scored = spreading.score_memories(active, inputs, nodes, spreading.SpreadParams())
    assert "BroadcastHashJoin" not in plan_of(scored) and scored.count() == 2
    frontier = active.select("query_id", "node", F.col("activation").alias("a"), F.lit(None).cast("string").alias("parent"), F.array("node").alias("path"))
    table = cut_lineage(spreading.weighted_links(links, spreading.SpreadParams(), True))
    hop = plan_of(spreading._hop(frontier, table, ["query_id"], spreading.SpreadParams(), (inputs.select("query_id", "vec"), nodes.select("node", "vec"))))
    assert "SortMergeJoin [neighbour#" in hop and "SortMergeJoin [query_id#" in hop
    near = nearest.vector_topk(nodes.select("scope", "node", "vec"), inputs.select("query_id", "scope", "vec"), 1, "node", "query_id", ["scope"])
    assert "SortMergeJoin [scope#" in plan_of(near) and [r.node for r in near.collect()] == ["e1"]
    sets = components.connected_components(nodes.select(F.col("node").alias("id")), links.select(F.col("node").alias("a"), F.col("neighbour").alias("b")))
    assert "BroadcastHashJoin" not in plan_of(sets) and {r.component for r in sets.collect()} == {"e1"}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_what_a_table_was_shuffled_for_goes_when_it_is_written(spark):
    before, setting = shuffle_files(spark), spark.conf.get(session.FREE_SHUFFLES, None)
    table = cut_lineage(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    assert not shuffle_files(spark) - before and table.count() == 100
    assert spark.conf.get(session.FREE_SHUFFLES, None) == setting


def test_only_tables_of_the_application_are_dropped(spark, tmp_path):
    table = cut_lineage(spark.range(5))
    folder = table.inputFiles()[0].split(":")[-1].rsplit("/", 1)[0]
    drop_table(table)
    assert not os.path.exists("/" + folder.lstrip("/"))
    spark.range(5).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        drop_table(spark.read.parquet(str(tmp_path / "other")))
    assert spark.read.parquet(str(tmp_path / "other")).count() == 5


@shared
def test_a_session_graph_keeps_no_table_it_does_not_need(spark):
    folder = session.cut_folder(spark).split(":")[-1]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    graph = catalog.QUERIES["session_graph"](spark, FOLDER)
    # The graph with the degree of one end, the degrees, what their shift was made of and the shift.
    assert graph.count() > 0 and len(set(os.listdir(folder)) - before) <= 4


def test_links_of_sessions_that_come_again_are_marked_once(spark):
    links = cut_lineage(spark.createDataFrame([("u", s, f"m:{s}", "e:x" if s < 3 else "e:y", "entity") for s in range(5)], "scope string, session long, b string, a string, kind string").select(*sessions.LINKS[:1], "session", *sessions.LINKS[1:]))
    again = cut_lineage(spark.createDataFrame([("u", 1, [], [], None)], "scope string, session long, memories array<struct<text:string,entities:array<string>,round:int>>, entities array<struct<name:string,is_a:array<string>>>, episode struct<title:string,text:string>"))
    new, shift = sessions.replaced_links(links, again)
    assert sorted(r.session for r in new.collect()) == [0, 2, 3, 4]
    assert {(r.node, r["shift"]) for r in shift.collect()} == {("m:1", -1), ("e:x", -1)}
    # One table holds what goes and what stays.
    assert plan_of(new).count("Join") == 0


def tables(spark):
    folder = session.cut_folder(spark).split(":")[-1]
    return {f"{folder}/{name}" for name in (os.listdir(folder) if os.path.isdir(folder) else ())}


def test_edges_that_were_climbed_leave_the_disk(spark):
    edges = spark.createDataFrame([("s", "d", "PROVIDES"), ("d", "c1", "CONTAINS"), ("d", "c2", "CONTAINS"), ("r", "s", "CONTAINS")], "src string, dst string, relation string")
    before = tables(spark)
    reach = graph.closure(spark.createDataFrame([("r", "r")], "start string, node string"), edges)
    above = graph.provenance(edges, spark.createDataFrame([("c1",), ("c2",)], "id string"))
    assert not [t for t in tables(spark) - before if "src" in spark.read.parquet(t).columns]
    assert sorted((r.node, r.depth) for r in reach.collect()) == [("c1", 3), ("c2", 3), ("d", 2), ("r", 0), ("s", 1)]
    assert sorted((r.node, r.ancestor) for r in above.collect()) == [(c, x) for c in ("c1", "c2") for x in sorted([c, "d", "s", "r"])]


def test_arms_over_and_under_their_limit_keep_what_single_calls_keep(spark):
    random.seed(3)
    pairs = {(f"n{random.randint(0, 11)}", f"n{random.randint(12, 30)}") for _ in range(60)}
    links = spark.createDataFrame([(a, b, k) for x, y in sorted(pairs) for k in [random.choice(["MENTIONS", "IN_SESSION"])] for a, b in ((x, y), (y, x))], "node string, neighbour string, kind string")
    seeds = spark.createDataFrame([(q, f"n{n}", 1.0, "w") for q in range(3) for n in (q, q + 4)], "query_id long, node string, activation double, why string")
    specs = ["few[max_nodes=3]", "all[max_nodes=1000]", "one[max_nodes=5;hops=1]"]
    found = arms.spread_arms(seeds, links, arms.arm_table(spark, specs))
    got = sorted((r.arm, r.query_id, r.node, round(r.activation, 9)) for r in found.collect())
    expected = []
    for spec in specs:
        expected += [(spec, r.query_id, r.node, round(r.activation, 9)) for r in spreading.spread_sum(seeds, links, spreading.arm_params(spec)[1]).collect()]
    assert got == sorted(expected) and sum(x[0] == specs[0] for x in got) == 9


def test_links_that_were_spread_over_leave_the_disk(spark):
    links = spark.createDataFrame([("a", "b", "MENTIONS"), ("b", "a", "MENTIONS"), ("b", "c", "MENTIONS"), ("c", "b", "MENTIONS")], "node string, neighbour string, kind string")
    seeds = spark.createDataFrame([(1, "a", 1.0, "w")], "query_id long, node string, activation double, why string")
    for run in (lambda: arms.spread_arms(seeds, links, arms.arm_table(spark, ["x", "y[hops=1]"])), lambda: spreading.spread_distinct(seeds, links, spreading.SpreadParams())):
        before = tables(spark)
        found = run()
        left = [spark.read.parquet(t).columns for t in tables(spark) - before]
        assert not [c for c in left if "neighbour" in c] and {r.node for r in found.collect()} == {"a", "b", "c"}
