"""Trace analytics on event logs derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluation, traces
from .registry import query


def order_trace(t) -> DataFrame:
    """Orders as queries: their lines are candidates, spawned, pruned or found, in line order."""
    text = F.lit(None).cast("string")
    query_id = F.col("l_orderkey").cast("string")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    kind = (F.when(F.col("l_linenumber") % 4 == 1, F.lit("CANDIDATES_GENERATED")).when(F.col("l_linenumber") % 4 == 2, F.lit("BRANCH_SPAWNED"))
            .when(F.col("l_returnflag") == "R", F.lit("NODE_PRUNED")).otherwise(F.lit("EVIDENCE_FOUND")))
    def event(number, kind_, node):
        return F.struct(F.lit(number).alias("step"), kind_.alias("event_type"), node.alias("node_id"),
                        F.when(kind_ == "CANDIDATES_GENERATED", F.array(part)).alias("candidates"), F.when(kind_ == "EVIDENCE_FOUND", F.concat(F.lit("e:"), part)).alias("evidence_id"))
    steps = F.array(event(0, F.lit("CANDIDATES_GENERATED"), text), event(1, kind, F.when(kind != "CANDIDATES_GENERATED", part)))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t.lineitem.select(query_id.alias("query_id"), place.alias("place"), part.alias("part"), F.explode(steps).alias("s"))
    sequence = F.col("place.l_linenumber").cast("long") * 2 + F.col("s.step")
    return rows.select("query_id", sequence.alias("sequence"), "s.event_type", "s.node_id", F.concat(F.lit("b"), "part").alias("branch_id"), F.lit("N1").alias("need_id"), "s.candidates",
                       text.alias("shown"), F.lit(None).cast("array<string>").alias("needs"), F.lit(None).cast("array<string>").alias("path"), text.alias("source"), text.alias("target"),
                       "s.evidence_id", F.when(F.col("s.evidence_id").isNotNull(), F.col("part")).alias("evidence_node"), text.alias("url"), text.alias("document_id"))


@query("trace_states", """WITH o AS (SELECT l_orderkey::VARCHAR AS query_id, 'p' || l_partkey AS part, l_linenumber AS ln, CASE WHEN l_linenumber % 4 = 1 THEN 'CANDIDATE' WHEN l_linenumber % 4 = 2 THEN 'ACTIVE' WHEN l_returnflag = 'R' THEN 'PRUNED' ELSE 'EVIDENCE' END AS st FROM lineitem),
n AS (SELECT query_id, part, bool_or(st = 'EVIDENCE') AS ev, arg_max(st, ln) AS last FROM o GROUP BY ALL)
SELECT query_id, part AS node, CASE WHEN ev THEN 'EVIDENCE' ELSE last END AS state FROM n UNION ALL SELECT query_id, 'e:' || part, 'EVIDENCE' FROM n WHERE ev""")
def _states(t):
    return traces.node_states(order_trace(t))


@query("trace_edges", """WITH o AS (SELECT l_orderkey::VARCHAR AS query_id, 'p' || l_partkey AS part, l_linenumber % 4 AS m, l_returnflag AS f FROM lineitem),
e AS (SELECT query_id, 'need:N1' AS src, part AS dst, CASE WHEN m = 2 THEN 'route' ELSE 'candidate' END AS caption FROM o UNION ALL SELECT query_id, part, 'e:' || part, 'supports' FROM o WHERE m IN (3, 0) AND f <> 'R')
SELECT query_id, src, dst, max(caption) AS caption, CASE WHEN max(caption) = 'route' THEN 'b' || dst END AS branch_id, false AS active FROM e GROUP BY query_id, src, dst""")
def _edges(t):
    return traces.edge_states(order_trace(t))


@query("recall_funnel", """WITH m AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders), c AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS node FROM lineitem),
e AS (SELECT o_custkey AS query_id, l_partkey AS node, bool_or(l_linenumber = 1 AND l_returnflag = 'A') AS f, bool_or(l_linenumber = 2) AS s, bool_or(l_linenumber = 3 AND l_returnflag = 'R') AS pp, bool_or(l_linenumber = 3 AND l_returnflag <> 'R') AS pb, bool_or(l_linenumber = 4) AS cd
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
g AS (SELECT m.query_id, m.doc_id, bool_or(f) AS f, bool_or(s) AS s, bool_or(pp) AS pp, bool_or(pb) AS pb, bool_or(cd) AS cd FROM m JOIN c USING (doc_id) JOIN e ON e.query_id = m.query_id AND e.node = c.node GROUP BY ALL)
SELECT CASE WHEN f THEN 'evidence found but not in final context' WHEN s THEN 'explored, relevance check rejected' WHEN pp THEN 'candidate, pruned by navigation policy' WHEN pb THEN 'candidate, cut by breadth cap'
  WHEN cd THEN 'candidate, never scheduled (global budget)' ELSE 'never a candidate' END AS stage, count(*) AS n FROM m LEFT JOIN g USING (query_id, doc_id) GROUP BY stage""")
def _funnel(t):
    missed = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    closure = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("node_id")).distinct()
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    stage = (F.when((n == 1) & (flag == "A"), F.lit("found")).when(n == 2, F.lit("spawned")).when((n == 3) & (flag == "R"), F.lit("pruned_policy"))
             .when(n == 3, F.lit("pruned_budget")).when(n == 4, F.lit("candidate")))
    events = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("node_id"), stage.alias("stage"))
    return evaluation.recall_funnel(missed, events.where("stage is not null"), closure).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("leaderboard", """WITH a AS (SELECT event_type AS method, quality = 1 AS correct, toxic = 1 AS major_omission, value FROM events JOIN labels ON doc_id = user_id),
w AS (SELECT *, CASE WHEN NOT correct OR major_omission THEN false ELSE value >= 5 END AS win FROM a)
SELECT method, count(*) AS graded, count(*) FILTER (win) AS wins, count(*) FILTER (correct) AS correct, count(*) FILTER (correct AND major_omission) AS omissions, count(*) FILTER (value < 5) AS unsupported FROM w GROUP BY method""")
def _board(t):
    rows = t.events.join(t.labels, F.col("doc_id") == F.col("user_id")).select(
        F.col("event_type").alias("method"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("major_omission"), F.lit("r").alias("reason"),
        F.least(F.lit(1.0), F.floor(F.col("value") / 5)).alias("supported"), F.lit(True).alias("grounded"), F.lit(False).alias("fallback"), F.lit(1.0).alias("gold_recall"), F.lit(10).alias("words"),
        F.lit(1.0).alias("seconds"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("error"))
    board = evaluation.leaderboard(evaluation.verdicts(rows))
    return board.select("method", "graded", "wins", "correct", "omissions", "unsupported")


@query("accuracy_report", """WITH a AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS arm, l_orderkey AS q, max(l_quantity) > 25 AS label FROM lineitem GROUP BY ALL),
j AS (SELECT arm, q, o_orderpriority AS type, label FROM a JOIN orders ON o_orderkey = q), f AS (SELECT q FROM j GROUP BY q HAVING count(DISTINCT arm) = 3)
SELECT arm, type, count(*) AS n, round(avg(label::INT), 6) AS accuracy FROM j WHERE q IN (SELECT q FROM f) GROUP BY GROUPING SETS ((arm), (arm, type))""")
def _accuracy(t):
    arm = F.when(F.col("l_linenumber") % 3 == 0, F.lit("bm25")).when(F.col("l_linenumber") % 3 == 1, F.lit("dense")).otherwise(F.lit("hybrid"))
    judged = t.lineitem.groupBy(arm.alias("arm"), F.col("l_orderkey").alias("query_id")).agg((F.max("l_quantity") > 25).alias("label"))
    typed = judged.join(t.orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("type")), "query_id")
    return evaluation.accuracy_report(typed.withColumn("label", F.col("label").cast("int"))).withColumn("accuracy", F.round("accuracy", 6))
