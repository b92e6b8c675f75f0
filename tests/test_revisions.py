import random
import uuid

from pyspark.sql import functions as F

from lorekeep.operators import clinical, forgetting, recoding, sessions
from lorekeep.sources import versions
from lorekeep.sources.taxonomies import IS_A


def keyed(spark, tmp_path, key=("k",)):
    return versions.KeyedLog(spark, f"{tmp_path}/{uuid.uuid4().hex}", list(key), "k long, v string, n array<struct<a:long,b:string>>")


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, []) for k, v in pairs], "k long, v string, n array<struct<a:long,b:string>>")


def shown(log):
    return sorted((r.k, r.v) for r in log.current().collect())


def test_whole_keys_are_replaced_and_late_ones_lose(spark, tmp_path):
    log = keyed(spark, tmp_path)
    assert shown(log) == []
    log.append(rows(spark, (1, "a"), (1, "b"), (2, "c"), (3, "d")), 5)
    log.append(rows(spark, (1, "x")), 9)
    log.append(rows(spark, (1, "late"), (2, "late")), 3)
    assert shown(log) == [(1, "x"), (2, "c"), (3, "d")]
    log.append(rows(spark), 10, rows(spark, (3, "")).select("k"))
    log.append(rows(spark, (4, "same"), (4, "same")), 10)
    log.append(rows(spark, (4, "wins ties by order")), 10)
    want = [(1, "x"), (2, "c"), (4, "wins ties by order")]
    assert shown(log) == want
    log.compact()
    assert shown(log) == want and len(log.batches()) == 1
    log.append(rows(spark, (3, "too late"), (1, "too late")), 8)
    assert shown(log) == want
    log.append(rows(spark, (3, "back")), 11)
    assert shown(log) == [(1, "x"), (2, "c"), (3, "back"), (4, "wins ties by order")]
    again = versions.KeyedLog(spark, log.path, log.key, log.schema)
    assert shown(again) == shown(log)


def test_nothing_stored_is_rewritten(spark, tmp_path):
    log = keyed(spark, tmp_path)
    log.append(rows(spark, (1, "a"), (2, "b")), 1)
    before = log.batches()
    log.append(rows(spark, (2, "c")), 2)
    assert log.batches()[:1] == before
    assert spark.read.parquet(f"{log.batches()[1][1]}/rows").count() == 1


def test_a_dead_batch_is_not_read_and_failures_are_bounded(spark, tmp_path):
    log = versions.KeyedLog(spark, f"{tmp_path}/run", ["q"], "q long, status string, failures int")
    work = spark.createDataFrame([(i,) for i in range(10)], "q long")
    calls = []

    def run(pending):
        calls.append(sorted((r.q, r.failures) for r in pending.collect()))
        return pending.withColumn("status", F.when(F.col("q") < 2, "failed").otherwise("done"))

    log._write(run(versions.pending(work, log)).withColumn("_at", F.lit(1.0)), work.withColumn("_at", F.lit(1.0)).withColumnRenamed("q", "q"))
    calls.clear()
    for moment in range(5):
        versions.resume(work, log, run, moment, limit=2)
    assert [len(c) for c in calls] == [10, 2, 0, 0, 0] and calls[1] == [(0, 1), (1, 1)]
    assert sorted(map(tuple, log.current().collect())) == [(i, "failed" if i < 2 else "done", 2 if i < 2 else 0) for i in range(10)]


def test_support_counting_against_sets(spark):
    random.seed(4)
    for seed in range(3):
        nodes = [f"n{i}" for i in range(60)]
        links = {(nodes[a], nodes[b]) for a, b in ((random.randrange(60), random.randrange(60)) for _ in range(70)) if a < b}
        links |= {("z0", "z1"), ("z1", "z2"), ("z2", "z3"), ("n0", "z3")}
        gone = {"n0", "n1", "n2", "z0", *random.sample(nodes, 12), "unknown"}
        want, left = dict.fromkeys(gone, 0), {*nodes, "z1", "z2", "z3"}
        number = 0
        while True:
            number += 1
            falls = {b for b in left - set(want) if any(y == b for _, y in links) and all(x in want for x, y in links if y == b)}
            if not falls:
                break
            want |= dict.fromkeys(falls, number)
        found = forgetting.fallen(spark.createDataFrame([*links, *links], "namer string, named string"), spark.createDataFrame([(g,) for g in gone], "node string"))
        assert {r.node: r["round"] for r in found.collect()} == want
        assert want["z3"] >= 3


def test_forgotten_names_in_normal_form_and_scope(spark):
    memories = spark.createDataFrame([("u", 1, ["Café", "Tea"]), ("u", 2, ["cafe"]), ("v", 1, ["Tea"])], "scope string, id long, entities array<string>")
    entities = spark.createDataFrame([("u", "CAFÉ", ["Place"]), ("u", "tea", ["Drink"]), ("u", "drink", []), ("u", "place", []), ("v", "tea", ["drink"]), ("v", "drink", [])],
                                     "scope string, name string, is_a array<string>")
    wanted = spark.createDataFrame([("u", 1), ("u", 1), ("v", 9)], "scope string, id long")
    kept, left, count = forgetting.forget_memories(memories, entities, wanted)
    assert sorted((r.scope, r.id) for r in kept.collect()) == [("u", 2), ("v", 1)]
    assert sorted((r.scope, r.name) for r in left.collect()) == [("u", "CAFÉ"), ("u", "place"), ("v", "drink"), ("v", "tea")]
    assert [tuple(r) for r in count.collect()] == [("u", 1)]


def test_replaced_links_equal_those_made_anew(spark):
    schema = "scope string, session long, episode struct<title:string,text:string>, memories array<struct<text:string,entities:array<string>,round:int>>, entities array<struct<name:string,is_a:array<string>>>"
    def session(i, names, episode=None, scope="u"):
        return (scope, i, episode, [(f"memory {n}", [n, "Shared"], k % 2 or None) for k, n in enumerate(names)], [(n, ["kind " + n[0], n]) for n in names])
    first = spark.createDataFrame([session(1, ["ann", "bob"], ("t", "x")), session(2, ["bob", "cid"]), session(3, ["dan"], None, "v"), session(4, [], ("t", "y"))], schema)
    again = spark.createDataFrame([session(1, ["bob", "eve"]), session(5, ["ann"])], schema)
    links, shift = sessions.replaced_links(sessions.session_links(first), again)
    whole = sessions.session_links(first.where("session <> 1").unionByName(again))
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, whole.select(links.columns).collect()))
    degrees = sessions.shifted(sessions.node_degrees(sessions.session_graph(sessions.session_links(first))), shift)
    assert sorted(map(tuple, degrees.drop("specificity").collect())) == sorted(map(tuple, sessions.node_degrees(sessions.session_graph(whole)).collect()))


def test_cleaned_sessions_count_what_is_dropped(spark):
    frame = spark.createDataFrame([("u", 1, "We met in the town and had tea.", [("They met in town.", ["town"]), ("他们见面了", ["x"])], ("Meeting", "他们")),
                                   ("u", 2, "We met.", [], None)],
                                  "scope string, session long, source string, memories array<struct<text:string,entities:array<string>>>, episode struct<title:string,text:string>")
    found = {r.session: r for r in sessions.cleaned(frame).collect()}
    assert (found[1].dropped, len(found[1].memories), found[1].episode) == (2, 1, None) and found[2].dropped == 0


def test_second_recoding_changes_nothing(spark):
    concepts = spark.createDataFrame([("11", "heart attack (disorder)", "disorder", 2), ("12", "heart (body structure)", "body structure", 1)], "id string, fsn string, tag string, depth int")
    terms = spark.createDataFrame([("heart attack", "11", False), ("heart", "12", False)], "norm string, concept string, fsn boolean")
    memories = spark.createDataFrame([(1, [("txt:heart attack", "Heart attack", "finding", None), ("sct:12", "Heart", "body structure", None)]), (2, [("txt:zzz", "Zzz", "", None)]),
                                      (3, [("sct:11", "MI", "disorder", None), ("txt:heart attack", "Heart attack", "finding", None)]), (4, [])], f"memory_id long, concepts {recoding.CONCEPT}")
    once, touched = recoding.recode(memories, recoding.recodable(memories, terms, concepts))
    found = {r.memory_id: [(c.key, c.was) for c in r.concepts] for r in once.collect()}
    assert found == {1: [("sct:11", "txt:heart attack"), ("sct:12", None)], 2: [("txt:zzz", None)], 3: [("sct:11", None), ("sct:11", "txt:heart attack")], 4: []}
    assert sorted(r.memory_id for r in touched.collect()) == [1, 3]
    links, shift = recoding.relinked(recoding.concept_links(memories), once, touched)
    assert sorted(map(tuple, links.collect())) == [(1, "sct:11"), (1, "sct:12"), (2, "txt:zzz"), (3, "sct:11")]
    assert recoding.recodable(once, terms, concepts).collect() == []
    twice, again = recoding.recode(once, recoding.recodable(once, terms, concepts))
    assert again.collect() == [] and sorted(map(str, twice.select("memory_id", F.transform("concepts", lambda c: c["key"])).collect())) == sorted(
        map(str, once.select("memory_id", F.transform("concepts", lambda c: c["key"])).collect()))


def test_extended_closure_equals_a_new_one(spark):
    random.seed(2)
    edges = [(f"c{i}", IS_A, f"c{random.randrange(i)}") for i in range(1, 80) for _ in range(2)]
    relations = spark.createDataFrame(edges, "source string, type string, target string")
    codes = spark.createDataFrame([(f"c{i}",) for i in range(80)], "code string")
    old = clinical.ancestor_closure(relations, codes.where("code like '%1' or code like '%4'"))
    found = recoding.extended_closure(old, relations, codes)
    whole = clinical.ancestor_closure(relations, codes)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert recoding.extended_closure(whole, relations, codes).count() == whole.count()
