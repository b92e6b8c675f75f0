"""Operators on small fixtures, against brute force or worked cases."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import clinical, components, concepts, context, exploration, fusion, graph, inference, memory, nearest, settle, skew, spreading
from lorekeep.sources import conversations, extraction, passages, structure, taxonomies


def test_greedy_budget_skips_and_goes_on(spark):
    rng = random.Random(3)
    rows = [(q, i, rng.randint(0, 40), i) for q in range(6) for i in range(200)]
    expected = set()
    for q in range(6):
        used = 0
        for _, i, size, _ in [r for r in rows if r[0] == q]:
            if used + size <= 100:
                used += size
                expected.add((q, i))
    df = spark.createDataFrame(rows, "query_id int, doc_id int, size int, rank int")
    assert {tuple(r) for r in context.greedy_budget(df, 100).collect()} == expected


def test_pack_context_truncates_like_a_plain_pass(spark):
    rng = random.Random(5)
    for budget in (120, 300):
        rows = [("q", f"e{i}", i, rng.choice([5, 30, 80, 200]), rng.choice([3, 6])) for i in range(60)]
        used, expected = 1, []
        for _, name, place, tokens, overhead in rows:
            cost = tokens + overhead + 1
            if used + cost <= budget:
                used += cost
                expected.append((name, tokens, False))
            elif (left := budget - used - (cost - tokens) - 16) > 40:
                used += min(left, tokens) + overhead + 1
                expected.append((name, min(left, tokens), True))
        df = spark.createDataFrame(rows, "query_id string, evidence_id string, place int, text_tokens int, overhead int")
        got = [(r["evidence_id"], r["kept_tokens"], r["truncated"]) for r in context.pack_context(df, budget).orderBy("place").collect()]
        assert got == expected


def test_context_order_round_robin_and_by_source(spark):
    rows = [("q", "a1", "n", ["n1"], "docA", 0.9, 1), ("q", "a2", "n", ["n1"], "docA", 0.8, 2), ("q", "b1", "n", ["n1"], "docB", 0.7, 3)]
    df = spark.createDataFrame(rows, "query_id string, evidence_id string, node_id string, need_ids array<string>, document_id string, relevance double, found int").withColumn(
        "contradicts", F.array().cast("array<string>"))
    needs = spark.createDataFrame([("q", "n1", 0)], "query_id string, need_id string, need_no int")
    def order(placed):
        return [r["evidence_id"] for r in context.context_order(placed).orderBy("place").collect()]
    assert order(context.grouped_by_need(df, needs)) == ["a1", "a2", "b1"]
    assert order(context.grouped_by_source(df)) == ["a1", "b1", "a2"]


def test_working_memory_equals_the_step_by_step_state(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows, expected = [], {}
    for key in ("x", "y"):
        at, held, last = start, {}, None
        for i in range(150):
            at += dt.timedelta(minutes=rng.choice([5, 40, 200]))
            cues = {f"c{rng.randint(0, 30)}": rng.random() for _ in range(3)}
            rows += [(key, i, at, c, v) for c, v in cues.items()]
            held = {} if last is None or at - last > dt.timedelta(hours=3) else {c: v * 0.5 for c, v in held.items()}
            for c, v in cues.items():
                held[c] = max(held.get(c, 0), v)
            held = dict(sorted(held.items(), key=lambda kv: (-kv[1], kv[0]))[:5])
            last = at
        expected[key] = held
    df = spark.createDataFrame(rows, "key string, update_id int, at timestamp_ntz, cue string, activation double")
    got = {}
    for r in memory.working_memory(df, ["key"], hours=3, decay=0.5, size=5).collect():
        got.setdefault(r["key"], {})[r["cue"]] = r["activation"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert all(abs(got[k][c] - expected[k][c]) < 1e-12 for k in got for c in got[k])


def brute_components(items, same, same_text):
    parent = {i: i for i in items}
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in itertools.combinations(items, 2):
        x, y = items[a], items[b]
        if x["g"] != y["g"]:
            continue
        c = round(float(np.dot(x["vec"], y["vec"])), 9)
        f, g = x["figures"], y["figures"]
        if (f == g and c >= (same if f else same_text)) or (f and g and f != g and c >= same and x["date"] != y["date"]):
            parent[find(a)] = find(b)
    sets = {}
    for i in items:
        sets.setdefault(find(i), set()).add(i)
    return {frozenset(s) for s in sets.values()}


@pytest.mark.parametrize("block", [1024, 7])
def test_similar_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(settle, "BLOCK", block)
    rng = np.random.default_rng(1)
    items, rows = {}, []
    for i in range(90):
        v = rng.normal(size=6) if i % 3 else np.ones(6)  # a third are copies
        v = (v / np.linalg.norm(v)).tolist()
        item = {"g": "hot" if i % 4 else "cold", "figures": ["", "5", "7"][i % 3], "date": f"2024-01-0{i % 2 + 1}", "vec": v}
        items[i] = item
        rows.append((i, item["g"], item["figures"], item["date"], v))
    df = spark.createDataFrame(rows, "id long, g string, figures string, date string, vec array<double>")
    links = settle.similar_links(df, ["g"], 0.7, 0.8)
    sets = {}
    for r in components.connected_components(df.select("id"), links).collect():
        sets.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(s) for s in sets.values()} == brute_components(items, 0.7, 0.8)
    assert links.count() < 4 * len(items)  # no group of copies is multiplied out


def test_settle_repeats_and_changes(spark):
    v = [1.0, 0.0]
    rows = [("a", "s", "practise 20 minutes", "2024-01-01", 0.5, v), ("b", "s", "practise 20 minutes a day", "2024-01-02", 0.6, v), ("c", "s", "practise 45 minutes", "2024-01-03", 0.4, v),
            ("d", "other", "practise 45 minutes", "2024-01-03", 0.4, v)]
    df = spark.createDataFrame(rows, "id string, subject string, text string, date string, score double, vec array<double>")
    survivors, members = settle.settle(df, ["subject"])
    got = {r["id"]: r for r in survivors.collect()}
    assert set(got) == {"c", "d"} and got["c"]["seen"] == 1 and got["c"]["before"] == ["practise 20 minutes a day"] and got["c"]["score"] == 0.6
    assert sorted(r["id"] for r in members.where("survivor_id = 'c'").collect()) == ["a", "b", "c"]


def test_connected_components_on_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    df = components.connected_components(spark.createDataFrame([(i,) for i in [*range(61), *range(100, 160), 500]], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in df.collect()} == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 160)} | {(500, 500)}


def test_blocked_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(2)
    base, asked = rng.normal(size=(70, 5)), rng.normal(size=(9, 5))
    base[10:30] = base[0]  # copies tie and are ranked by id
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in nearest.vector_topk(rows, queries, 6).collect()}
    for q, v in enumerate(asked):
        cos = np.round(base @ v / (np.linalg.norm(base, axis=1) * np.linalg.norm(v)), 9)
        best = sorted(range(70), key=lambda i: (-cos[i], i))[:6]
        assert [got[(q, k + 1)] for k in range(6)] == best


def test_salted_join_is_whole(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i int, k string")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3)], "k string, v int")
    got = skew.salted_join(big, other, ["k"], salts=4, hot_rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(other, "k").collect()))
    assert skew.salted_join(big, other, ["k"], 4, "left_anti", 50).count() == big.join(other, "k", "left_anti").count()


def test_hub_spreads_less_and_zero_hops_reach_nothing(spark):
    links = [("m1", "e1", "MENTIONS", 0), ("m2", "e1", "MENTIONS", 0)] + [(f"x{i}", "hub", "MENTIONS", 0) for i in range(40)] + [("m1", "hub", "MENTIONS", 0)]
    pairs = spreading.pair_links(spark.createDataFrame(links, "src string, dst string, kind string, at int"))
    seeds = spark.createDataFrame([("q", "e1", 1.0, "e1")], "query_id string, node string, activation double, why string")
    none = spreading.spread_sum(seeds, pairs, spreading.SpreadParams(hops=0))
    assert [r["node"] for r in none.collect()] == ["e1"]
    got = {r["node"]: r for r in spreading.spread_sum(seeds, pairs, spreading.SpreadParams(hops=2)).collect()}
    assert abs(got["m2"]["activation"] - 0.6) < 1e-12 and got["hub"]["path"] == ["e1", "m1", "hub"]
    assert "e1" in got and got["e1"]["activation"] == 1.0  # never back to the parent


def test_spread_with_vectors_prefers_relevant_neighbours(spark):
    pairs = spreading.pair_links(spark.createDataFrame([("s", n, "MENTIONS", 0) for n in "abc"], "src string, dst string, kind string, at int"))
    seeds = spark.createDataFrame([("q", "s", 1.0, "s")], "query_id string, node string, activation double, why string")
    vectors = (spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<double>"),
               spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "node string, vec array<double>"))
    got = spreading.spread(seeds, pairs, spreading.SpreadParams(hops=1, top_k=1), vectors)
    assert {r["node"] for r in got.collect()} == {"s", "a"}


def test_cycle_and_edge_rejects(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "src string, dst string")
    assert {r["id"] for r in graph.cyclic_nodes(edges).collect()} == {"a", "b", "c", "d"}
    assert graph.cyclic_nodes(edges.where("src <> 'c'")).count() == 0


def test_protected_taxonomy(spark):
    nodes = spark.createDataFrame([("m", "Concept", "MAIN"), ("l", "Concept", "LOCAL")], "id string, kind string, origin string")
    edges = spark.createDataFrame([("l", "m", "BROADER_THAN"), ("l", "m", "RELATED_TO"), ("m", "l", "BROADER_THAN")], "src string, dst string, relation string")
    assert [tuple(r) for r in graph.protected_edges(nodes, edges).select("src", "relation").collect()] == [("l", "BROADER_THAN")]


def test_rounds_with_leading_assistant(spark):
    turns = [("s", 0, "assistant", "hi"), ("s", 1, "user", "a"), ("s", 2, "assistant", "b"), ("s", 3, "user", "c"), ("t", 0, "user", "z")]
    df = conversations.with_rounds(spark.createDataFrame(turns, "session string, turn int, role string, content string"))
    assert {(r["session"], r["turn"]): r["round"] for r in df.collect()} == {("s", 0): 0, ("s", 1): 1, ("s", 2): 1, ("s", 3): 2, ("t", 0): 0}


def test_structure_levels_fences_and_leaves(spark):
    text = "# One\nBody.\n## Two\n1.2.3.4.5.6.7 Deep heading\nDeep body.\n2.5 times higher than before.\n## Three\nEnd.\n"
    rows = structure.outline(text, 600, 900, 500)
    assert [(r[4], r[5], r[6]) for r in rows if r[3] == "Section"] == [
        (1, "One", ["One"]), (2, "Two", ["One", "Two"]), (7, "1.2.3.4.5.6.7 Deep heading", ["One", "Two", "1.2.3.4.5.6.7 Deep heading"]), (2, "Three", ["One", "Three"])]
    assert len(structure.outline("```\n# no\n1.2 Not a heading\n```\n", 600, 900, 500)) == 1
    assert structure.outline("Brief source.", 600, 900, 500)[0][9] is True


@pytest.mark.parametrize("text", ["One sentence here. " * 300, "日本語です。😀 " * 200, "x" * 10_000, "A paragraph of words.\n\n" * 150])
def test_chunks_rebuild_the_text(text):
    count = (lambda s: len(s)) if text.startswith("x") else structure.count_words
    spans = structure.chunk_spans(text, 35, 50, count)
    assert "".join(text[a:b] for a, b in spans).strip() == text.strip() and all(count(text[a:b]) <= 50 for a, b in spans)


def test_sources_become_text(spark):
    rows = [("h", b"<h2>T</h2><script>x</script><p>Hi <b>you</b></p><nav>menu</nav><table><tr><td>c</td></tr></table>", "text/html"), ("j", b'\xef\xbb\xbf{"a": 1}', "application/json"),
            ("m", b"Subject: S\nFrom: f@x\n\nbody", "message/rfc822"), ("e", b"  ", "text/plain"), ("p", b"x", "application/pdf")]
    got = {r["k"]: r for r in extraction.extract_texts(spark.createDataFrame(rows, "k string, content binary, mime string"), "k").collect()}
    assert got["h"]["text"] == "\n\n## T\n\n\n\nHi **you**\n\n | c" and got["j"]["text"] == '{\n  "a": 1\n}'
    assert got["m"]["text"].startswith("Subject: S\nFrom: f@x\nDate: \n\nbody") and got["e"]["error"] and got["p"]["error"]


def test_collection_gaps(spark):
    def check(ids):
        return tuple(passages.collection_gaps(spark.createDataFrame([(i, "t") for i in ids], "pid string, text string")).first())
    assert check(["0", "1", "2"]) == (0, 0, 0) and check(["0", "2"]) == (0, 0, 1) and check(["0", "0"])[1] == 1


def test_skos_import(spark):
    s, base = taxonomies.SKOS, "http://x/"
    def lit(a, p, o, lang=None):
        return (base + a, s + p, o, False, lang, None)
    def link(a, p, b, full=None):
        return (base + a, full or s + p, base + b, True, None, None)
    rows = [(base + c, taxonomies.RDF_TYPE, s + "Concept", True, None, None) for c in "abc"] + [(base + "g", taxonomies.RDF_TYPE, s + "Collection", True, None, None)]
    rows += [lit("a", "prefLabel", "Music", "en"), lit("a", "prefLabel", "Musique", "fr"), lit("b", "prefLabel", "Piano", "en"), lit("c", "prefLabel", "Jazz", "en"), lit("g", "prefLabel", "Arts", "en")]
    rows += [link("b", "broader", "a"), link("a", "narrower", "b"), link("b", "broader", "c"), link("b", "related", "b"), link("g", "member", "a"), link("a", "scopeNote", "n"),
             (base + "n", taxonomies.RDF_VALUE, "All music", False, "en", None)]
    triples = spark.createDataFrame(rows, taxonomies.TRIPLES)
    nodes = taxonomies.skos_nodes(triples, "X")
    edges, dangling, loops = taxonomies.skos_links(triples, nodes, "X")
    labels = {r["uri"][-1]: (r["label"], r["description"]) for r in nodes.collect()}
    assert labels["a"] == ("Musique", "All music") and labels["b"][0] == "Piano"
    assert {r["relation"]: r["count"] for r in edges.groupBy("relation").count().collect()} == {"BROADER_THAN": 2, "HAS_MEMBER": 1, "RELATED_TO": 1}
    assert dangling.count() == 0 and loops.count() == 1
    again = taxonomies.manifest(nodes.repartition(3), edges, "X")
    assert taxonomies.import_state(taxonomies.manifest(nodes, edges, "X"), again) == "same"


def test_decision_reasons(spark):
    rows = [("ok", None, ["p"], 0.9), ("prov", None, ["p"], 0.6), ("lowreuse", "p", [], 0.6), ("low", None, ["p"], 0.4), ("unknown", "zz", [], 0.9), ("noparent", None, [], 0.9),
            ("unkparent", None, ["zz"], 0.9), ("noanchor", None, ["u"], 0.9), ("unanchored", "u", [], 0.9)]
    d = spark.createDataFrame(rows, "spec_id string, reuse_id string, parent_ids array<string>, confidence double")
    shown = spark.createDataFrame([(r[0], i) for r in rows for i in ("p", "u")], "spec_id string, id string")
    got = {r["spec_id"]: r["reason"] or r["outcome"] for r in concepts.judge_decisions(d, shown, spark.createDataFrame([("p",)], "id string")).collect()}
    assert got == {"ok": "accepted", "prov": "provisional", "lowreuse": "low_confidence", "low": "low_confidence", "unknown": "unknown_reuse_id", "noparent": "no_parent",
                   "unkparent": "unknown_parent_id", "noanchor": "no_anchor", "unanchored": "unanchored_reuse"}


def test_rare_words(spark):
    q = spark.createDataFrame([("a", "technique crispy"), ("b", "foods")], "query_id string, text string")
    f = spark.createDataFrame([("technique", 40)], "term string, df long")
    got = {}
    for r in concepts.rare_forms(q, f, F.lit(4500)).collect():
        got.setdefault(r["query_id"], []).append(r["form"])
    assert sorted(got["a"]) == ["crispy", "crispys"] and sorted(got["b"]) == ["food", "foods"]


def test_term_resolution_prefers_tags_and_depth(spark):
    concept = spark.createDataFrame([("1", "Cold (finding)", "finding", 3), ("2", "Cold (qualifier value)", "qualifier value", 5), ("3", "Heart valve disease (disorder)", "disorder", 4),
                                     ("4", "Native heart valve disease (disorder)", "disorder", 6)], "id string, fsn string, tag string, depth int")
    term = spark.createDataFrame([("1", "cold", 1), ("2", "cold", 1), ("3", "heart valve disease", 1), ("4", "native heart valve disease", 1)], "concept string, norm string, fsn int")
    asked = spark.createDataFrame([(1, "Colds", ""), (2, "cold", "disorder"), (3, "heart valve diseases of", "disorder"), (4, "unrelated words", ""), (5, "valve heart disease", "organism")],
                                  "mention_id int, term string, tag string")
    assert {tuple(r) for r in clinical.resolve_terms(asked, term, concept).collect()} == {(1, "2"), (2, "1"), (3, "3")}


def test_applicability_product_and_exclusion(spark):
    item = "array<struct<key:string,term:string>>"
    recs = spark.createDataFrame([("r1", [("sct:valve", "valve"), ("txt:fever", "fever")], []), ("r2", [("sct:valve", "valve")], [("sct:child", "child")]), ("r3", [], []), ("r4", [("sct:gone", "gone")], [])],
                                 f"rec_id string, conditions {item}, exclusions {item}")
    relation = spark.createDataFrame([("child", taxonomies.IS_A, "valve")], "source string, type string, target string")
    memories = spark.createDataFrame([("p", "m1", "high fever today", "present", "patient", "note", [("sct:child", "c", "disorder")]), ("p", "m2", "x", "absent", "patient", "note", [("sct:gone", "g", "disorder")]),
                                      ("p", "m3", "x", "present", "family", "note", [("sct:gone", "g", "disorder")])],
                                     "patient string, memory_id string, text string, state string, subject string, source string, concepts array<struct<key:string,term:string,tag:string>>")
    pairs = spark.createDataFrame([("p", f"r{i}") for i in range(1, 5)], "patient string, rec_id string")
    got = {r["rec_id"]: r for r in clinical.applicability(recs, pairs, clinical.patient_facts(memories, relation), memories).collect()}
    assert got["r1"]["factor"] == pytest.approx(0.9) and got["r1"]["met"] == ["valve", "fever"]
    assert got["r2"]["factor"] == 0.0 and got["r2"]["excluded_by"] == ["child"]
    assert got["r3"]["factor"] == 0.35 and got["r4"]["factor"] == 0.05 and got["r4"]["not_met"] == ["gone"]


def test_exploration_caps_floor_and_one_hop(spark):
    empty = []
    nodes = [(f"leaf{i}", "Chunk", f"piano{i}", empty, f"piano voicings text {i}", "", "", [1.0], 0, False) for i in range(12)]
    nodes += [("topic", "Concept", "piano voicings", empty, "", "", "about piano", [1.0], 0, False), ("far", "Chunk", "far", empty, "hidden practice", "", "", [0.0], 0, False)]
    schema = "id string, kind string, label string, aliases array<string>, text string, summary string, routing_summary string, embedding array<double>, hits int, retrieval_leaf boolean"
    n = spark.createDataFrame(nodes, schema)
    edges = spark.createDataFrame([("far", "topic", "ABOUT")], "src string, dst string, relation string")
    prov = n.where("kind = 'Chunk'").select(F.col("id").alias("node_id"), F.col("id").alias("document_id"))
    q = spark.createDataFrame([("q", "piano voicings", [1.0])], "query_id string, text string, vec array<double>")
    needs = inference.question_as_need(q).withColumn("vec", F.array(F.lit(1.0)))
    found = exploration.explore(needs, q, n, edges, prov)
    branches = found["branches"].collect()
    assert sum(b["outcome"] == "explored" and b["action"] == "SELECT" for b in branches) <= 8
    assert any(b["outcome"] == "branch_budget" for b in branches) and found["evidence"].count() >= 1
    # A need without evidence expands its container once and reaches the leaf behind it.
    q2 = spark.createDataFrame([("q", "about piano practice", [1.0])], "query_id string, text string, vec array<double>")
    n2 = inference.question_as_need(q2).withColumn("vec", F.array(F.lit(1.0)))
    only = n.where("id in ('topic', 'far')")
    deep = exploration.explore(n2, q2, only, edges, prov, policy=lambda s, r: F.when(F.lit(True), F.when(r, F.lit("SELECT")).otherwise(F.lit("EXPAND"))),
                               relevance=lambda p: p.withColumn("relevant", F.col("text").contains("practice")).withColumn("relevance", F.lit(0.8)))
    assert [r["node_id"] for r in deep["evidence"].collect()] == ["far"]


def test_cached_inference_asks_each_payload_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "known")], "id int, payload string")
    key = inference.cache_key("op", "1", "default", F.lit("known"))
    cache = spark.range(1).select(key.alias("key"), F.lit('{"x": 9}').alias("output"))

    def model(payload):
        if payload == "known":
            raise ValueError("cached payloads are never asked")
        return "{" if payload == "bad" else '{"x": 1}'

    done, fresh = inference.cached_inference(rows, model, "x int", cache, "op")
    got = {r["id"]: (r["result"] and r["result"]["x"], r["error"] is None) for r in done.collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (None, False), 4: (9, True)} and fresh.count() == 1


def test_assertion_rejects(spark):
    a = spark.createDataFrame([("ok", "l", "quote", [], "2024-01-01", "2024-02-01"), ("q", "l", "absent", [], None, None), ("c", "l", "quote", ["zz"], None, None), ("t", "l", "quote", [], "2024-03-01", "2024-02-01")],
                              "assertion_id string, leaf_id string, supporting_quote string, contradicts_ids array<string>, valid_from string, valid_to string")
    leaves = spark.createDataFrame([("l", "a quote here")], "id string, text string")
    got = {tuple(r) for r in inference.assertion_rejects(a, leaves, spark.createDataFrame([("y",)], "id string")).collect()}
    assert got == {("q", "quote_absent"), ("c", "unknown_contradiction"), ("t", "inverted_range")}


def test_interleave_and_rrf(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, doc_id string, rank int")
    assert [r["doc_id"] for r in fusion.interleave([a, b], 3).orderBy("rank").collect()] == ["x", "y", "z"]
    fused = fusion.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert fused[0]["doc_id"] == "y" and fused[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
