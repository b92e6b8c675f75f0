"""Sessions as they are remembered: extractions without debris, stored whole per (scope, session), and the graph their memories make."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import memory_id
from ..functions.text import corrupted, norm
from ..session import cut_lineage
from .graph import specificity

LINKS = ["scope", "a", "b", "kind"]


def cleaned(sessions: DataFrame) -> DataFrame:
    """Sessions without degenerate memories and episodes; `dropped` counts them.

    sessions: scope, session, source (its transcript), memories array<struct<text,entities>>, episode struct<title,text>. An episode stays although memories
    of its session go, and the other way round.
    """
    kept = F.filter("memories", lambda m: ~F.coalesce(corrupted(m["text"], F.col("source")), F.lit(False)))
    bad = F.col("episode").isNotNull() & (F.coalesce(corrupted(F.col("episode.text"), F.col("source")), F.lit(False))
                                          | F.coalesce(corrupted(F.col("episode.title"), F.col("source")), F.lit(False)))
    rows = sessions.withColumn("__kept", kept).withColumn("dropped", F.size("memories") - F.size("__kept") + bad.cast("int"))
    return rows.withColumn("memories", F.col("__kept")).withColumn("episode", F.when(~bad, F.col("episode"))).drop("__kept", "source")


def session_links(sessions: DataFrame) -> DataFrame:
    """(scope, session, a, b, kind): each session's own links, every unordered pair once; of several kinds the last in the order below holds.

    sessions: scope, session, memories array<struct<text,entities,round>>, entities array<struct<name,is_a>>, episode struct<title,text>. Nodes: `s:` session, `r:`
    session and round, `m:` session and digest of the text, `e:` entity in normal form.
    """
    sid = F.col("session").cast("string")
    session, entity = F.concat(F.lit("s:"), sid), lambda n: F.concat(F.lit("e:"), norm(n))
    memories = sessions.select("scope", "session", F.posexplode("memories").alias("place", "m")).withColumn("node", F.concat(F.lit("m:"), memory_id(sid, F.col("m.text"))))
    round_ = F.concat(F.lit("r:"), sid, F.lit(":"), F.col("m.round").cast("string"))
    named = memories.select("scope", "session", "node", F.explode("m.entities").alias("n")).where(norm(F.col("n")) != "")
    classes = sessions.select("scope", "session", F.explode("entities").alias("e")).select("scope", "session", "e.name", F.explode("e.is_a").alias("c"))
    episodes = sessions.where("episode is not null").withColumn("node", F.concat(F.lit("m:"), sid, F.lit(":episode")))
    members = named.select("scope", "session", entity(F.col("n")).alias("entity")).distinct()

    def links(rows, a, b, kind, rank):
        return rows.select("scope", "session", a.alias("x"), b.alias("y"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))

    found = (links(memories.where("m.round is not null"), session, round_, "round", 0)
             .unionByName(links(memories.where("m.round is not null"), round_, F.col("node"), "memory", 1))
             .unionByName(links(memories.where("m.round is null"), session, F.col("node"), "memory", 1))
             .unionByName(links(named, F.col("node"), entity(F.col("n")), "entity", 2))
             .unionByName(links(classes.where((norm(F.col("c")) != "") & (norm(F.col("name")) != "")), entity(F.col("name")), entity(F.col("c")), "category", 3))
             .unionByName(links(episodes, session, F.col("node"), "episode", 4))
             .unionByName(links(episodes.select("scope", "session", "node").join(members, ["scope", "session"]), F.col("node"), F.col("entity"), "episode", 4)))
    pairs = found.where("x <> y").select("scope", "session", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind", "rank")
    return pairs.groupBy("scope", "session", "a", "b").agg(F.max_by("kind", "rank").alias("kind"))


def replaced_links(links: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, shift) after the sessions in `sessions` came again: only their links are made anew. `shift` says by how much the degree
    of (scope, node) changes; a pair that several sessions link counts once."""
    keys = sessions.select("scope", "session").distinct()
    fresh = cut_lineage(session_links(sessions))
    # All links move once: what goes and what stays are parts of one table.
    marked = cut_lineage(links.join(keys.withColumn("__again", F.lit(True)), ["scope", "session"], "left"))
    old, rest = marked.where("__again").drop("__again"), marked.where("__again is null").drop("__again")
    # Pairs that only these sessions held or now hold; what other sessions link as well stays as it is.
    pair = ["scope", "a", "b"]
    moves = (old.select(*pair).distinct().withColumn("was", F.lit(1)).join(fresh.select(*pair).distinct().withColumn("now", F.lit(1)), pair, "full_outer")
             .where("was is null or now is null"))
    moves = moves.join(rest.select(*pair), pair, "left_anti").withColumn("n", F.when(F.col("now").isNotNull(), 1).otherwise(-1))
    ends = moves.select("scope", F.col("a").alias("node"), "n").unionByName(moves.select("scope", F.col("b").alias("node"), "n"))
    return rest.unionByName(fresh), cut_lineage(ends.groupBy("scope", "node").agg(F.sum("n").alias("shift")).where("shift <> 0"))


def session_graph(links: DataFrame) -> DataFrame:
    """(scope, a, b, kind) over all sessions, every pair once; of several kinds that of the last session holds.

    Dealt by `b` alone, the end with few links (entities, that many sessions share, sort before memories, rounds and sessions), so that what joins by it needs no other shuffle.
    """
    return links.repartition("scope", "b").groupBy("scope", "a", "b").agg(F.max_by("kind", F.struct("session", "kind")).alias("kind"))


def node_degrees(graph: DataFrame) -> DataFrame:
    """(scope, node, degree)."""
    return graph.select("scope", F.explode(F.array("a", "b")).alias("node")).groupBy("scope", "node").agg(F.count(F.lit(1)).alias("degree"))


def shifted(degrees: DataFrame, shift: DataFrame, fan0: int = 5) -> DataFrame:
    """(scope, node, degree, specificity) after a shift; nodes without links are gone."""
    rows = degrees.select("scope", "node", "degree").join(shift, ["scope", "node"], "full_outer")
    rows = rows.select("scope", "node", (F.coalesce("degree", F.lit(0)) + F.coalesce("shift", F.lit(0))).cast("long").alias("degree")).where("degree > 0")
    return rows.withColumn("specificity", specificity(F.col("degree"), fan0))
