import random

import pytest

from lorekeep.operators import arms, spreading
from lorekeep.sources import imports


def closure_of(links, nodes):
    above = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for child, parent in links:
            if not above[parent] <= above[child]:
                above[child] |= above[parent]
                changed = True
    return {(c, a) for c, found in above.items() for a in found}


def test_closure_kept_up_equals_a_new_one(spark):
    """Random graphs without cycles: links go and come, several ways carry one pair, nodes go and come."""
    random.seed(6)
    for _ in range(3):
        before = {(f"c{i}", f"c{random.randrange(i)}") for i in range(1, 40) for _ in range(2)}
        after = {l for l in before if random.random() < 0.8 and "c7" not in l} | {("new", "c3"), ("top", "new"), ("c39", "top")}
        nodes = {n for l in after for n in l}
        old = spark.createDataFrame(sorted(closure_of(before, {n for l in before for n in l})), "concept string, ancestor string")
        frame = lambda rows: spark.createDataFrame(sorted(rows), "child string, parent string")
        found = imports.kept_up(old, frame(after), frame(before - after), frame(after - before), spark.createDataFrame([(n,) for n in nodes], "id string"))
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == closure_of(after, nodes)


def snapshot(spark, links, extra=()):
    ids = sorted({n for l in links for n in l} | set(extra))
    nodes = spark.createDataFrame([(i, "Concept", "T", f"urn:{i}", i) for i in ids], "id string, kind string, origin string, uri string, label string")
    return nodes, spark.createDataFrame([(p, c, "BROADER_THAN", "T") for c, p in links], "src string, dst string, relation string, authority string")


def test_unsound_or_foreign_snapshots_are_refused(spark, tmp_path):
    nodes, edges = snapshot(spark, [("a", "b"), ("b", "c")])
    with pytest.raises(imports.Refused, match="cycle"):
        imports.import_taxonomy(None, *snapshot(spark, [("a", "b"), ("b", "a")]), "T")
    with pytest.raises(imports.Refused, match="dangling"):
        imports.import_taxonomy(None, nodes.where("id <> 'c'"), edges, "T")
    imports.write_normalized(f"{tmp_path}/s", nodes, edges, "T")
    schemas = (nodes.schema, edges.schema)
    again = imports.read_normalized(spark, f"{tmp_path}/s", *schemas, "T")
    outcome, stored = imports.import_taxonomy(None, *again, "T")
    assert outcome == "imported" and imports.import_taxonomy(stored, nodes, edges, "T")[0] == "same"
    with pytest.raises(imports.Refused, match="migration"):
        imports.import_taxonomy(stored, *snapshot(spark, [("a", "b")]), "T")
    nodes.limit(1).write.json(f"{tmp_path}/s/nodes", mode="append")
    with pytest.raises(imports.Refused, match="manifest"):
        imports.read_normalized(spark, f"{tmp_path}/s", *schemas, "T")


def test_another_authority_stays(spark):
    _, stored = imports.import_taxonomy(None, *snapshot(spark, [("a", "b")]), "T")
    nodes, edges = snapshot(spark, [("x", "y")])
    other = nodes.replace("T", "U", ["origin"])
    outcome, both = imports.import_taxonomy(stored, other, edges.replace("T", "U", ["authority"]), "U")
    assert outcome == "imported" and {(r.concept, r.ancestor) for r in both["closure"].collect()} == closure_of([("a", "b"), ("x", "y")], "abxy")
    outcome, moved = imports.import_taxonomy(both, *snapshot(spark, [("a", "c")]), "T", migrate=True)
    assert outcome == "migrated" and {(r.concept, r.ancestor) for r in moved["closure"].collect()} == closure_of([("a", "c"), ("x", "y")], "acxy")
    assert moved["manifest"].count() == 2


def test_arms_equal_one_call_each(spark):
    random.seed(3)
    pairs = [(f"n{a}", f"n{b}", random.choice(("MENTIONS", "IN_SESSION", "IS_A", "OTHER")), 0) for a, b in ((random.randrange(30), random.randrange(30)) for _ in range(160)) if a != b]
    pairs += [("hub", f"n{i}", "IS_A" if i % 2 else "MENTIONS", 0) for i in range(30)]
    links = spreading.pair_links(spark.createDataFrame(pairs, "src string, dst string, kind string, at int"))
    seeds = spark.createDataFrame([(1, "n1", 1.0, "one"), (1, "n2", 0.4, "two"), (2, "hub", 1.0, "hub")], "query_id long, node string, activation double, why string")
    specs = ["a", "b[hops=1;top_k=2]", "c[hops=3;decay=0.9;IS_A=1.0;top_k=4]", "d[MENTIONS=0;threshold=0.2;max_nodes=5]", "e[hops=0]"]
    found = arms.spread_arms(seeds, links, arms.arm_table(spark, specs)).collect()
    for spec in specs:
        alone = spreading.spread_sum(seeds, links, spreading.arm_params(spec)[1]).collect()
        mine = {(r.query_id, r.node): (round(r.activation, 9), r.path) for r in found if r.arm == spec}
        assert mine == {(r.query_id, r.node): (round(r.activation, 9), r.path) for r in alone}
    labels = spark.createDataFrame([("n1", "One"), ("hub", "Hub")], "node string, label string")
    named = arms.labelled_paths(arms.spread_arms(seeds, links, arms.arm_table(spark, ["a"])), labels, ["arm", "query_id", "node"]).collect()
    assert all("hub" not in r.path[1:] for r in named) and any("Hub" in r.path[1:] for r in named)
