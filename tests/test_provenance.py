"""Section paths by pointer doubling against a plain walk, contradictions with both places, provenance through shared containers."""

import random

from lorekeep.operators import graph

EDGE = "src string, dst string, relation string"


def walks(parents, node, seen):
    """Every way up from `node`, outermost first; ends below a node met before."""
    ups = [p for p in sorted(parents.get(node, ())) if p != node and p not in seen]
    blocked = [p for p in parents.get(node, ()) if p != node and p in seen]
    out = {(*way, p) for p in ups for way in walks(parents, p, seen | {p})}
    return out | ({()} if blocked or not ups else set())


def test_paths_equal_a_walk(spark):
    rnd = random.Random(4)
    for depth in (1, 2, 7, 13):
        rows = [(f"n{i}", f"n{i + 1}", "CONTAINS") for i in range(depth)] + [("other", "n1", "CONTAINS"), ("n0", "n0", "CONTAINS")]
        rows += [(f"n{rnd.randint(0, depth)}", f"leaf{k}", "CONTAINS") for k in range(20)] + [("s", "n0", "PROVIDES")]
        parents = {}
        for src, dst, relation in rows:
            if relation == "CONTAINS":
                parents.setdefault(dst, set()).add(src)
        leaves = [f"leaf{k}" for k in range(20)] + ["alone"]
        got = graph.section_paths(spark.createDataFrame(rows + rows[:2], EDGE), spark.createDataFrame([(x,) for x in leaves + leaves[:1]], "id string")).collect()
        assert sorted((r.node, tuple(r.path)) for r in got) == sorted((x, w) for x in leaves for w in walks(parents, x, {x}))


def test_a_cycle_ends_and_no_table_is_no_path(spark):
    rows = [("a", "b", "CONTAINS"), ("b", "c", "CONTAINS"), ("c", "a", "CONTAINS"), ("c", "leaf", "CONTAINS")]
    got = graph.section_paths(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("leaf",), ("a",)], "id string")).collect()
    assert {r.node: r.path for r in got} == {"leaf": ["a", "b", "c"], "a": ["b", "c"]}
    assert graph.section_paths(spark.createDataFrame([], EDGE), spark.createDataFrame([], "id string")).collect() == []


def test_contradictions_show_both_sides(spark):
    rows = [("d", "s1", "CONTAINS"), ("s1", "x", "CONTAINS"), ("e", "y", "CONTAINS"), ("x", "y", "CONTRADICTS"), ("y", "x", "CONTRADICTS")]
    edges, leaves = spark.createDataFrame(rows, EDGE), spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    got = {(r.node, tuple(r.path), r.other, tuple(r.other_path)) for r in graph.contradicted(edges, leaves).collect()}
    assert got == {("x", ("d", "s1"), "y", ("e",)), ("y", ("e",), "x", ("d", "s1"))}


def test_provenance_runs_through_supports_and_sources(spark):
    rows = [("web", "d", "PROVIDES"), ("d", "s", "CONTAINS"), ("s", "x", "CONTAINS"), ("claim", "x", "SUPPORTED_BY"), ("x", "claim", "SUPPORTED_BY")]
    got = graph.provenance(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("claim",), ("x",), ("lone",)], "id string")).collect()
    everything = {"claim", "x", "s", "d", "web"}
    assert {(r.node, r.ancestor) for r in got} == {("claim", a) for a in everything} | {("x", a) for a in everything} | {("lone", "lone")}
    assert len(got) == 11
