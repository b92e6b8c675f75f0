"""Inputs beyond limits that once cut data: budgets, long sessions, long labels and codes, part hours, deep chains, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from lorekeep.operators import clinical, concepts, exploration, graph, lexical, memory, nearest, settle
from lorekeep.operators.inference import embed
from lorekeep.sources import conversations, extraction, structure
from lorekeep.streaming import jobs


def test_node_budget_as_given(spark):
    branches = spark.range(100).select(F.lit("q").alias("query_id"), F.lit("n").alias("need_key"), F.col("id").cast("string").alias("node_id"), F.lit(0.5).alias("score"))
    left = exploration.budget_left(branches.select("query_id").distinct(), 200, branches.limit(20))
    assert exploration.within_budget(branches, left).count() == 100 and exploration.within_budget(branches, 61).count() == 61


def test_sessions_of_any_length(spark):
    turns = spark.range(301).select(F.lit("s").alias("session"), F.lit(dt.date(2024, 1, 1)).alias("day"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("content"))
    assert conversations.session_keys(turns).count() == 1
    text = conversations.transcripts(conversations.with_rounds(turns)).first()["transcript"]
    assert "USER: 300" in text and text.count("[round ") == 151


def test_long_labels_and_codes(spark):
    label = "l" * 1101
    specs = spark.createDataFrame([("s1", label, []), ("s2", label.upper(), [])], "spec_id string, label string, aliases array<string>")
    stored = spark.createDataFrame([("c", label, [], "MAIN")], "id string, label string, aliases array<string>, origin string")
    assert {r.concept_id for r in concepts.resolve_batch(specs, stored).collect()} == {"c"}
    rows = spark.createDataFrame([("sct:" + "9" * 120,)], "key string")
    assert rows.select(clinical.code_of("key").alias("c")).first()["c"] == "9" * 120


def test_part_hours(spark):
    at = dt.datetime(2024, 1, 1, 12)
    asked = spark.createDataFrame([("q", "s", "o", "k", at)], "query_id string, scope string, options string, key string, at timestamp")
    earlier = spark.createDataFrame([("k", "s", "o", at - dt.timedelta(minutes=10), True, 1)], "key string, scope string, options string, at timestamp, completed boolean, context_size int")
    changes = spark.createDataFrame([], "scope string, at timestamp")
    assert [memory.reusable_episode(asked, earlier, changes, hours).count() for hours in (0.1, 0.5, 1.5)] == [0, 1, 1]


def test_deep_chains_are_no_cycles(spark):
    chain = spark.range(12).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    assert graph.cyclic_nodes(chain).count() == 0
    assert graph.cyclic_nodes(chain.union(spark.createDataFrame([("12", "10")], "src string, dst string"))).count() == 3


def test_late_rows_arrive_in_the_side_table(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "key string, update_id long, at timestamp, cue string, activation double"

    def put(number, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={number}"))

    put(0, [("u", 1, base + dt.timedelta(minutes=30), "a", 1.0)])
    seen = []
    sink = jobs.with_late_table(lambda b, n: seen.extend((r.cue, r.activation) for r in b.collect()), str(tmp_path / "late"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "part=*"))
        job = jobs.working_memory_stream(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        job.awaitTermination(120)

    run()
    put(1, [("u", 2, base + dt.timedelta(minutes=10), "late", 0.7)])
    run()
    late = spark.read.parquet(str(tmp_path / "late")).collect()
    assert [(r.cue, r.activation) for r in late] == [("late", 0.7)] and ("a", 1.0) in seen and "late" not in dict(seen)


def test_vectors_meet_their_own_length(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "doc_id string, vec array<double>")
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0, 0.0])], "query_id string, vec array<double>")
    got = {(r.query_id, r.doc_id): r.score for r in nearest.vector_topk(rows, queries, 2).collect()}
    assert got["x", "a"] == 1.0 and got["y", "b"] == 1.0 and got["x", "b"] == 0.0


def test_zero_vectors_are_alike_to_nothing(spark):
    items = spark.createDataFrame([("a", "s", [0.0, 0.0], "", dt.date(2024, 1, 1)), ("b", "s", [0.0, 0.0], "", dt.date(2024, 1, 1))],
                                  "id string, scope string, vec array<double>, figures string, date date")
    assert settle.similar_links(items, ["scope"]).count() == 0


def test_short_passages_are_listed(spark):
    passages = spark.createDataFrame([(1, "two words"), (2, "these are four words"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "here these are four words stand")], "doc_id long, text string")
    assert [(r.item_id, r.doc_id) for r in lexical.containing(docs, passages).collect()] == [(2, 7)]
    assert sorted(r.item_id for r in lexical.too_short(passages).collect()) == [1, 3]


def test_a_model_answers_each_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(texts):
        calls.add(len(texts))
        return texts.map(lambda t: [1.0, 2.0])

    fn.__annotations__ = {}
    import pandas as pd
    fn.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    rows, fresh = embed(spark.createDataFrame([("a",), ("a",), ("b",)], "text string"), fn=fn)
    assert rows.count() == 3 and fresh.count() == 2 and rows.where("vec is not null").count() == 3 and calls.value == 2


def test_pages_mail_and_json_without_limits(spark):
    page = '<p>a<nav>x<nav>y</nav>z</nav>b</p><meta name="m" content="1"><meta property=p content=\'2&amp;\'><meta name="m" content="3"><h2 class="a>b">T</h2>&eacute;&#x1F600;&nope;<p cl'
    rows = [(1, page.encode(), "text/html"), (2, b"x" * 6_000_000, "text/plain"), (3, b"{bad", "application/json"), (4, b"a\xffb", "text/plain; charset=utf-8"), (5, None, "text/html")]
    got = {r.k: r for r in extraction.extract_texts(spark.createDataFrame(rows, "k int, content binary, mime string"), "k").collect()}
    assert got[1].text == "\n\nab\n\n## T\n\né😀&nope;" and got[1].meta == {"m": "3", "p": "2&"}
    assert len(got[2].text) == 6_000_000 and got[3].error and got[4].text == "a�b" and got[5].error.startswith("Empty source")
    small = extraction.extract_texts(spark.createDataFrame(rows[1:2], "k int, content binary, mime string"), "k", max_bytes=10).first()
    assert small.error == "Empty source or source exceeds size limit" and small.text is None


def test_underlined_headings_rollups_and_tokens():
    text = "Intro\n\nTitle\n=====\nOwn body.\nPart\n---\nInner one two.\n# Next\nEnd.\n- item\n---\n"
    rows = structure.outline(text, 600, 900, 0)
    sections = {r[5]: r for r in rows if r[3] == "Section"}
    assert [(r[4], r[5], r[6], r[2]) for r in sections.values()] == [(1, "Title", ["Title"], ""), (2, "Part", ["Title", "Part"], "Title"), (1, "Next", ["Next"], "")]
    assert sections["Title"][10] == "Own body.\n\nPart\nInner one two.\n" and sections["Title"][11] == 6 and sections["Part"][11] == 3
    assert [r[8] for r in rows if r[3] == "Chunk"] == ["Intro\n\n", "Own body.\n", "Inner one two.\n", "End.\n- item\n---\n"]


def test_texts_beyond_a_limit_are_rejected_only_when_one_is_given(spark):
    docs = spark.createDataFrame([(1, "t", "# A\n" * 2500)], "document_id int, title string, text string")
    assert structure.parse_structure(docs).where("error is null").count() == 2501
    assert [r.error for r in structure.parse_structure(docs, max_sections=2000).collect()] == ["Document exceeds section limit"]


def test_a_context_never_exceeds_its_budget(spark):
    from lorekeep.functions.text import token_count
    from lorekeep.plans import answering
    needs = spark.createDataFrame([("q", "N1", 0, "alpha beta", None)], "query_id string, need_id string, need_no int, description string, vec array<double>")
    questions = spark.createDataFrame([("q", "alpha beta", None)], "query_id string, text string, vec array<double>")
    nodes = spark.createDataFrame([(f"d{i}", "Document", "alpha beta", [], "alpha beta " + "word " * (150 + i), "", "", None, 0, True) for i in range(4)],
                                  "id string, kind string, label string, aliases array<string>, text string, summary string, routing_summary string, embedding array<double>, hits int, retrieval_leaf boolean")
    edges = spark.createDataFrame([("s", f"d{i}", "PROVIDES") for i in range(4)], "src string, dst string, relation string")
    found = answering.answer_context(needs, questions, nodes, edges, nodes.select(F.col("id").alias("node_id"), F.col("id").alias("document_id")), budget=400)["context"]
    rows = found.select("truncated", "kept_tokens", "overhead", token_count(F.col("text")).alias("t")).collect()
    assert len(rows) == 3 and [r.truncated for r in rows].count(True) == 1 and all(r.t <= r.kept_tokens for r in rows)
    assert 1 + sum(r.t + r.overhead + 1 for r in rows) <= 400
