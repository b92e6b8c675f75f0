"""Taxonomy import as one job: validated snapshots under an authority, guarded by their fingerprint, with an ancestor closure kept up by difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph
from ..session import cut_lineage, is_empty
from .taxonomies import fingerprint, import_state, manifest

#: What a stored taxonomy consists of.
PARTS = ("nodes", "edges", "manifest", "closure")


class Refused(ValueError):
    """The snapshot is unsound, or differs from the one that was imported."""


def check_snapshot(nodes: DataFrame, edges: DataFrame, authority: str) -> None:
    """Raises `Refused` with everything that a snapshot must not hold."""
    found = {r["problem"]: r["n"] for r in graph.snapshot_problems(nodes, edges, authority).collect() if r["n"]}
    for reason, n in ((r["reason"], r["count"]) for r in graph.edge_rejects(nodes, edges).groupBy("reason").count().collect()):
        found[f"edge_{reason}"] = n
    cycles = graph.cyclic_nodes(edges.where("relation = 'BROADER_THAN'")).count()
    if cycles:
        found["cycle"] = cycles
    if found:
        raise Refused(f"unsound snapshot of {authority}: {found}")


def write_normalized(path: str, nodes: DataFrame, edges: DataFrame, authority: str) -> None:
    """The JSON interchange form: nodes, edges and, last, the manifest."""
    nodes.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")
    manifest(nodes, edges, authority).write.json(f"{path}/manifest")


def read_normalized(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str, authority: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the interchange form, validated and compared with their manifest."""
    nodes, edges = spark.read.schema(nodes_schema).json(f"{path}/nodes"), spark.read.schema(edges_schema).json(f"{path}/edges")
    named = spark.read.schema("authority string, fingerprint string").json(f"{path}/manifest").first()
    if named is None or named["authority"] != authority or named["fingerprint"] != fingerprint(nodes, edges).first()["fingerprint"]:
        raise Refused(f"the manifest at {path} does not belong to these nodes and edges of {authority}")
    check_snapshot(nodes, edges, authority)
    return nodes, edges


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(gone, come): keys of rows that only the old or only the new snapshot has with this content."""
    def digests(rows):
        return rows.select(*key, F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("content")).distinct()
    a, b = digests(old), digests(new)
    return a.join(b, [*key, "content"], "left_anti").select(key).distinct(), b.join(a, [*key, "content"], "left_anti").select(key).distinct()


def broader(edges: DataFrame) -> DataFrame:
    """(child, parent) of a taxonomy's edges."""
    return edges.where("relation = 'BROADER_THAN'").select(F.col("dst").alias("child"), F.col("src").alias("parent")).distinct()


def whole_closure(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(concept, ancestor), each concept its own ancestor."""
    starts = nodes.select(F.col("id").alias("concept"), F.col("id").alias("node"))
    found = graph.closure(starts, links.select(F.col("child").alias("src"), F.col("parent").alias("dst")), "concept")
    return found.select("concept", F.col("node").alias("ancestor"))


def kept_up(closure: DataFrame, links: DataFrame, gone: DataFrame, come: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure after links went and came; only pairs that a changed link can carry are looked at again.

    links: (child, parent) as they are now; gone and come: what changed; nodes: (id) as they are now. First every pair is taken back that ran over a link that
    went, then those that another way still carries are derived again, then pairs over new links are added, round by round to a fixpoint.
    """
    pair = ["concept", "ancestor"]
    live = nodes.select("id").distinct()
    lower = closure.select(F.col("concept").alias("low"), F.col("ancestor").alias("child"))
    upper = closure.select(F.col("concept").alias("parent"), F.col("ancestor").alias("high"))
    doubted = gone.join(lower, "child").join(upper, "parent").select(F.col("low").alias("concept"), F.col("high").alias("ancestor")).distinct()
    own = live.select(F.col("id").alias("concept"), F.col("id").alias("ancestor"))
    here = closure.join(live.select(F.col("id").alias("concept")), "concept", "left_semi").join(live.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(pair)
    kept = cut_lineage(here.join(doubted, pair, "left_anti").unionByName(own).distinct())
    open_ = cut_lineage(doubted.join(here, pair, "left_semi").join(kept, pair, "left_anti"))
    steps = cut_lineage(links.select(F.col("child").alias("concept"), F.col("parent").alias("via")))
    while not is_empty(open_):
        way = open_.join(steps, "concept").join(kept.select(F.col("concept").alias("via"), "ancestor"), ["via", "ancestor"], "left_semi")
        again = cut_lineage(way.select(pair).distinct())
        if is_empty(again):
            break
        kept = cut_lineage(kept.unionByName(again))
        open_ = cut_lineage(open_.join(again, pair, "left_anti"))
    fresh_links = cut_lineage(come.join(links, ["child", "parent"], "left_semi"))
    while not is_empty(fresh_links):
        below = kept.select(F.col("concept").alias("low"), F.col("ancestor").alias("child")).join(fresh_links, "child").select("low", "parent").distinct()
        found = below.join(kept.select(F.col("concept").alias("parent"), "ancestor"), "parent").select(F.col("low").alias("concept"), "ancestor").distinct()
        found = cut_lineage(found.join(kept, pair, "left_anti"))
        if is_empty(found):
            break
        kept = cut_lineage(kept.unionByName(found))
    return kept


def import_taxonomy(stored: dict[str, DataFrame] | None, nodes: DataFrame, edges: DataFrame, authority: str, migrate: bool = False) -> tuple[str, dict[str, DataFrame]]:
    """(outcome, stored): imported, same or migrated, and the taxonomy as it is stored then.

    An identical snapshot does nothing; another one is refused unless it is a migration, which rewrites nodes, edges and closure by difference.
    Rows of other authorities in `stored` stay.
    """
    check_snapshot(nodes, edges, authority)
    new = cut_lineage(manifest(nodes, edges, authority).select("authority", "fingerprint"))
    if stored is None:
        return "imported", {"nodes": nodes, "edges": edges, "manifest": new, "closure": cut_lineage(whole_closure(nodes, broader(edges)))}
    state = import_state(stored["manifest"], new)
    if state == "same":
        return state, stored
    if state == "differs" and not migrate:
        raise Refused(f"another snapshot of {authority} is imported already; a change needs a migration")
    others = {"nodes": stored["nodes"].where(F.col("origin") != authority), "manifest": stored["manifest"].where(F.col("authority") != authority)}
    theirs = others["nodes"].select("id")
    old_edges = stored["edges"].join(theirs.select(F.col("id").alias("dst")), "dst", "left_anti")
    kept_edges = stored["edges"].join(theirs.select(F.col("id").alias("dst")), "dst", "left_semi").select(stored["edges"].columns)
    before, after = broader(old_edges), broader(edges)
    gone = before.join(after, ["child", "parent"], "left_anti")
    come = after.join(before, ["child", "parent"], "left_anti")
    all_nodes, all_edges = others["nodes"].unionByName(nodes.select(stored["nodes"].columns)), kept_edges.unionByName(edges.select(stored["edges"].columns))
    closure = kept_up(stored["closure"], broader(all_edges), cut_lineage(gone), cut_lineage(come), all_nodes)
    return "migrated" if state == "differs" else "imported", {"nodes": all_nodes, "edges": all_edges, "manifest": others["manifest"].unionByName(new), "closure": closure}
