"""Trace analytics: what an event log says about each node and edge of a query's exploration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EXPLORED = ["EXPANDED", "SELECTED", "EVIDENCE"]  # fixed values: states that later sightings do not undo
# The state an event gives the node it is about.
EVENT_STATES = {"BRANCH_SPAWNED": "ACTIVE", "NODE_PRUNED": "PRUNED", "EVIDENCE_FOUND": "EVIDENCE", "BACKTRACK": "DEAD_END"}

EVENT_SCHEMA = (
    "query_id string, sequence long, event_type string, node_id string, branch_id string, need_id string, candidates array<string>, shown string, "
    "needs array<string>, path array<string>, source string, target string, evidence_id string, evidence_node string, url string, document_id string")


def need_node(need: Column) -> Column:
    return F.concat(F.lit("need:"), need)


def observations(events: DataFrame) -> DataFrame:
    """(query_id, sequence, part, node, how, state): every sighting of a node in the log, in order."""
    kind = F.col("event_type")
    def seen(part, node, how, state):
        return F.struct(F.lit(part).alias("part"), node.alias("node"), F.lit(how).alias("how"), (F.lit(state) if isinstance(state, str) else state).alias("state"))
    def many(part, nodes, how, state):
        return F.transform(F.coalesce(nodes, F.array().cast("array<string>")), lambda n: seen(part, n, how, state))
    def one(when, part, node, how, state):
        return F.when(when & node.isNotNull(), F.array(seen(part, node, how, state))).otherwise(F.array().cast("array<struct<part:int,node:string,how:string,state:string>>"))
    table = F.create_map(*[F.lit(x) for pair in EVENT_STATES.items() for x in pair])
    rows = F.concat(
        F.when(kind == "QUERY_DECOMPOSED", many(0, F.transform("needs", lambda n: need_node(n)), "upsert", "ACTIVE")).otherwise(many(0, F.lit(None).cast("array<string>"), "upsert", "ACTIVE")),
        F.when(kind == "CANDIDATES_GENERATED", many(1, F.col("candidates"), "upsert", "CANDIDATE")).otherwise(many(1, F.lit(None).cast("array<string>"), "upsert", "CANDIDATE")),
        one(F.col("shown").isNotNull(), 2, F.col("shown"), "upsert", F.when(kind == "NODE_SELECTED", F.lit("SELECTED")).otherwise(F.lit("EXPANDED"))),
        one(kind.isin(list(EVENT_STATES)), 3, F.col("node_id"), "set", F.element_at(table, kind)),
        one(kind == "EVIDENCE_FOUND", 4, F.col("evidence_id"), "upsert", "EVIDENCE"),
        one(kind == "EXTERNAL_SOURCE_FOUND", 5, F.col("url"), "upsert", "ACTIVE"),
        one(kind == "EXTERNAL_SOURCE_REJECTED", 6, F.col("url"), "reject", "PRUNED"),
        one(kind == "SOURCE_INGESTED", 7, F.col("document_id"), "upsert", "ACTIVE"))
    return events.select("query_id", "sequence", F.explode(rows).alias("o")).select("query_id", "sequence", "o.*")


def next_state(current: Column, how: Column, state: Column) -> Column:
    """One step of a node's life. `set` and `reject` only change nodes that were seen before."""
    explored = F.coalesce(current.isin(EXPLORED), F.lit(False))
    upserted = F.when((current == "EVIDENCE") | (explored & ~state.isin(EXPLORED)), current).otherwise(state)
    kept = (current == "EVIDENCE") | ((state == "PRUNED") & explored)
    return F.when(how == "upsert", upserted).when(current.isNull(), current).when(how == "reject", state).otherwise(F.when(kept, current).otherwise(state))


def node_states(events: DataFrame) -> DataFrame:
    """(query_id, node, state) after the whole log. A node's own sightings are folded in order, a query is never gathered."""
    grouped = observations(events).groupBy("query_id", "node").agg(F.array_sort(F.collect_list(F.struct("sequence", "part", "how", "state"))).alias("log"))
    fold = F.aggregate("log", F.lit(None).cast("string"), lambda s, x: next_state(s, x["how"], x["state"]))
    return grouped.select("query_id", "node", fold.alias("state")).where(F.col("state").isNotNull())


def edge_states(events: DataFrame) -> DataFrame:
    """(query_id, src, dst, caption, branch_id, active): each link's last description; the last traversed one is active."""
    kind = F.col("event_type")
    origin = F.coalesce("node_id", need_node(F.col("need_id")))
    def link(a, b, caption, branch=None):
        return F.struct(a.alias("src"), b.alias("dst"), F.lit(caption).alias("caption"), (branch if branch is not None else F.lit(None).cast("string")).alias("branch_id"))
    nothing = F.array().cast("array<struct<src:string,dst:string,caption:string,branch_id:string>>")
    parent = F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise(need_node(F.col("need_id")))
    links = F.concat(
        F.when(kind == "CANDIDATES_GENERATED", F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda n: link(origin, n, "candidate"))).otherwise(nothing),
        F.when((kind == "BRANCH_SPAWNED") & F.col("node_id").isNotNull(), F.array(link(parent, F.col("node_id"), "route", F.col("branch_id")))).otherwise(nothing),
        F.when(kind == "EDGE_TRAVERSED", F.array(link(F.col("source"), F.col("target"), "route", F.col("branch_id")))).otherwise(nothing),
        F.when(kind == "EVIDENCE_FOUND", F.array(link(F.col("evidence_node"), F.col("evidence_id"), "supports"))).otherwise(nothing),
        F.when(kind == "EXTERNAL_SOURCE_FOUND", F.array(link(need_node(F.col("need_id")), F.col("url"), "searched"))).otherwise(nothing),
        F.when(kind == "SOURCE_INGESTED", F.array(link(F.col("url"), F.col("document_id"), "ingested"))).otherwise(nothing))
    rows = events.select("query_id", "sequence", (kind == "EDGE_TRAVERSED").alias("walked"), F.explode(links).alias("l")).select("query_id", "sequence", "walked", "l.*")
    rows = rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    # A candidate link never overwrites what is known about a link.
    strong = F.col("caption") != "candidate"
    last = rows.groupBy("query_id", "src", "dst").agg(
        F.coalesce(F.max_by("caption", F.when(strong, F.col("sequence"))), F.lit("candidate")).alias("caption"),
        F.max_by("branch_id", F.when(F.col("branch_id").isNotNull(), F.col("sequence"))).alias("branch_id"), F.max(F.when(F.col("walked"), F.col("sequence"))).alias("walked_at"))
    newest = rows.where("walked").groupBy("query_id").agg(F.max("sequence").alias("newest"))
    return last.join(newest, "query_id", "left").select("query_id", "src", "dst", "caption", "branch_id", F.coalesce(F.col("walked_at") == F.col("newest"), F.lit(False)).alias("active"))
