"""Associative recall for many inputs: seeds, spreading, gates, settled facts and carried cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import norm, terms
from ..functions.vectors import hash_embedding
from ..operators import fusion, memory, settle, spreading
from ..operators.skew import shuffled, top_per_group
from ..session import cut_lineage, drop_table
from .graphs import key
from .registry import query


def recall(inputs: DataFrame, nodes: DataFrame, links: DataFrame, names: DataFrame, params=None, carried: DataFrame | None = None,
           sim_floor: float = 0.47, relative: float = 0.25, other_subject: float = 0.3, limit: int = 8, episodes: int = 2) -> dict[str, DataFrame]:
    """Facts, episodes and cues that inputs bring back.

    inputs: query_id, scope, text, vec, date, subject; nodes: scope, node, kind, label, text, vec, date, state, source,
    confidence, session, subject, episode; links: node, neighbour, kind (both directions).
    """
    params = params or spreading.SpreadParams(hops=1)
    seeds = spreading.seed_nodes(inputs, nodes, names, params, carried=carried)
    active = spreading.spread(seeds, links, params, (inputs.select("query_id", "vec"), nodes.select("node", "vec")))
    # Everything below reads the ranking several times.
    ranked = cut_lineage(spreading.score_memories(active, inputs, nodes, params))
    cues = top_per_group(ranked.where("kind = 'entity'"), ["query_id"], [F.round("score", 12).desc(), F.col("node")], 20)

    named = spreading.named_entities(inputs, names)
    touched = (named.join(shuffled(links), "node").select("query_id", F.col("neighbour").alias("node")).distinct().withColumn("named", F.lit(True)))
    judged = inputs.select("query_id", F.when(F.col("vec").isNull(), F.lit(0.0)).otherwise(F.lit(sim_floor)).alias("floor"),
                           norm(F.coalesce("subject", F.lit(""))).alias("here"))
    about = (ranked.where("kind = 'memory'").join(shuffled(touched), ["query_id", "node"], "left").join(shuffled(judged), "query_id")
             .where((F.col("similarity") >= F.col("floor")) | F.coalesce("named", F.lit(False))))
    there = norm(F.coalesce("subject", F.lit("")))
    damped = F.when((F.col("here") != "") & (there != "") & (there != F.col("here")), F.col("score") * other_subject).otherwise(F.col("score"))
    kept = fusion.relative_cut(about.withColumn("score", damped), ["query_id"], relative)
    facts = kept.where(~F.coalesce("episode", F.lit(False))).join(shuffled(nodes.select("node", "vec")), "node")
    items = cut_lineage(facts.select(F.concat_ws("|", "query_id", "node").alias("id"), "query_id", there.alias("subject_key"),
                                     (F.col("state") == "assistant_said").alias("said"), "text", "date", "score", "vec"))
    survivors, members = settle.settle(items, ["query_id", "subject_key", "said"])
    return {
        "memories": top_per_group(survivors, ["query_id"], [F.round("score", 9).desc(), F.col("id")], limit),
        "members": members,
        "episodes": top_per_group(kept.where("episode"), ["query_id"], [F.round("score", 9).desc(), F.col("node")], episodes),
        "cues": cues,
    }


# --- Links of the shared tables: customer - order - part ---
def trade_links(t) -> DataFrame:
    """A stored table: degrees and the choice of neighbours both read it."""
    orders = t.orders.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit("IN_SESSION").alias("kind"), F.lit(0).alias("at"))
    parts = t.lineitem.select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("MENTIONS").alias("kind"), F.lit(0).alias("at"))
    return cut_lineage(spreading.pair_links(orders.unionByName(parts)))


SPREAD_SQL = """one AS (SELECT DISTINCT 'c:' || o_custkey AS a, 'o:' || o_orderkey AS b, 0.3 AS w FROM orders UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 1.0 FROM lineitem),
l AS (SELECT a AS node, b AS nb, w FROM one UNION ALL SELECT b, a, w FROM one),
spec AS (SELECT node, 1 / (1 + ln(greatest(1.0, count(*) / 5.0))) AS spec FROM l GROUP BY node),
seeds AS (SELECT DISTINCT c_nationkey AS query_id, 'c:' || c_custkey AS seed FROM customer),
h1 AS (SELECT query_id, seed, l.nb AS node, 1.0 * 0.6 * spec * w AS gain, row_number() OVER (PARTITION BY query_id, seed ORDER BY w DESC, nb DESC) AS r
  FROM seeds JOIN l ON l.node = seed JOIN spec ON spec.node = seed QUALIFY r <= 8)"""


@query("spread_distinct", f"""WITH {SPREAD_SQL},
h2 AS (SELECT h.query_id, h.seed, l.nb AS node, h.gain * 0.6 * spec * w AS gain, row_number() OVER (PARTITION BY h.query_id, h.seed, h.node ORDER BY w DESC, nb DESC) AS rk
  FROM h1 h JOIN l ON l.node = h.node JOIN spec ON spec.node = h.node WHERE h.gain >= 0.05 AND l.nb <> h.seed QUALIFY rk <= 8),
reach AS (SELECT query_id, seed, node, max(a) AS a FROM (SELECT query_id, seed, seed AS node, 1.0 AS a FROM seeds UNION ALL SELECT query_id, seed, node, gain FROM h1
  UNION ALL SELECT query_id, seed, node, gain FROM h2) GROUP BY ALL),
total AS (SELECT query_id, node, sum(a) AS activation FROM reach GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 12) DESC, node) AS r FROM total)
SELECT query_id, node, round(activation, 6) AS activation FROM ranked WHERE r <= 300""")
def _distinct(t):
    seeds = t.customer.select(F.col("c_nationkey").alias("query_id"), key("c", "c_custkey").alias("node"), F.lit(1.0).alias("activation"), key("c", "c_custkey").alias("why"))
    links = trade_links(t)
    found = spreading.spread_distinct(seeds, links, spreading.SpreadParams()).select("query_id", "node", F.round("activation", 6).alias("activation"))
    drop_table(links)  # the operator has written what it takes of them
    return found


@query("spread_sum", f"""WITH {SPREAD_SQL},
r1 AS (SELECT query_id, node, sum(gain) AS a, arg_min(seed, (-gain, seed)) AS parent FROM h1 GROUP BY ALL),
h2 AS (SELECT r.query_id, l.nb AS node, r.a * 0.6 * spec * w AS gain, row_number() OVER (PARTITION BY r.query_id, r.node ORDER BY w DESC, nb DESC) AS rk
  FROM r1 r JOIN l ON l.node = r.node JOIN spec ON spec.node = r.node WHERE r.a >= 0.05 AND l.nb <> r.parent QUALIFY rk <= 8),
total AS (SELECT query_id, node, sum(a) AS activation FROM (SELECT query_id, seed AS node, 1.0 AS a FROM seeds UNION ALL SELECT query_id, node, a FROM r1 UNION ALL SELECT query_id, node, gain FROM h2) GROUP BY ALL)
SELECT query_id, node, round(activation, 6) AS activation FROM total""")
def _sum(t):
    seeds = t.customer.select(F.col("c_nationkey").alias("query_id"), key("c", "c_custkey").alias("node"), F.lit(1.0).alias("activation"), key("c", "c_custkey").alias("why"))
    params = spreading.SpreadParams(max_nodes=1_000_000)
    return spreading.spread_sum(seeds, trade_links(t), params).select("query_id", "node", F.round("activation", 6).alias("activation"))


@query("near_duplicates", """WITH RECURSIVE i AS (SELECT vec_id AS id, label % 3 AS g, CASE WHEN vec_id % 2 = 0 THEN 'v' || vec_id % 4 ELSE '' END AS f, vec_id % 5 AS d, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.g = b.g AND a.id <> b.id WHERE
  (a.f = b.f AND round(list_dot_product(a.v, b.v), 9) >= CASE WHEN a.f <> '' THEN 0.35 ELSE 0.4 END)
  OR (a.f <> '' AND b.f <> '' AND a.f <> b.f AND a.d <> b.d AND round(list_dot_product(a.v, b.v), 9) >= 0.35)),
reach AS (SELECT id, id AS other FROM i UNION SELECT r.id, p.b FROM reach r JOIN p ON p.a = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def _near(t):
    from ..operators.components import connected_components
    rows = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("g"),
                               F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("v"), (F.col("vec_id") % 4).cast("string"))).otherwise(F.lit("")).alias("figures"),
                               (F.col("vec_id") % 5).alias("date"), F.col("embedding").alias("vec"))
    links = settle.similar_links(rows, ["g"], 0.35, 0.4)
    return connected_components(rows.select("id"), links)


def conversation_memory(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, names): user and assistant turns as memories, their long words as entities, one scope per user.

    Stored tables: every step of a recall reads them, and the turns' words and vectors are made once.
    """
    scope = F.concat(F.lit("user:"), (F.col("conv_id") % 5).cast("string"))
    session = F.concat(F.lit("s:"), F.col("conv_id").cast("string"))
    node = F.concat(F.lit("m:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    turns = t.conversations.where("role <> 'system'").select(
        scope.alias("scope"), session.alias("session"), node.alias("node"), "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 60).cast("int")).alias("date"),
        F.when(F.col("role") == "user", F.lit("stated")).otherwise(F.lit("assistant_said")).alias("state"))
    words = cut_lineage(turns.select("scope", "session", "node", F.explode(F.filter(terms(F.col("text")), lambda w: F.length(w) >= 9)).alias("word")))
    entity = F.concat(F.lit("e:"), "scope", F.lit(":"), "word")
    entities = words.select("scope", entity.alias("node"), F.col("word").alias("label")).distinct()
    empty = F.lit(None)
    memories = turns.select("scope", "node", F.lit("memory").alias("kind"), F.substring("text", 1, 80).alias("label"), "text", hash_embedding(F.col("text")).alias("vec"), "date", "state",
                            empty.cast("string").alias("source"), F.lit(0.9).alias("confidence"), "session", F.lit("").alias("subject"), F.lit(False).alias("episode"))
    named = entities.select("scope", "node", F.lit("entity").alias("kind"), "label", F.col("label").alias("text"), hash_embedding(F.col("label")).alias("vec"), empty.cast("date").alias("date"),
                            empty.cast("string").alias("state"), empty.cast("string").alias("source"), empty.cast("double").alias("confidence"), empty.cast("string").alias("session"),
                            F.lit("").alias("subject"), F.lit(False).alias("episode"))
    links = (words.select(F.col("node").alias("src"), entity.alias("dst"), F.lit("MENTIONS").alias("kind"), F.lit(0).alias("at"))
             .unionByName(turns.select(F.col("node").alias("src"), F.col("session").alias("dst"), F.lit("IN_SESSION").alias("kind"), F.lit(0).alias("at"))))
    names = spreading.entity_names(entities.withColumn("synonyms", F.array().cast("array<string>")))
    return cut_lineage(memories.unionByName(named)), cut_lineage(spreading.pair_links(links)), cut_lineage(names)


@query("recall")
def _recall(t):
    nodes, links, names = conversation_memory(t)
    first = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    inputs = first.select(F.col("conv_id").alias("query_id"), F.concat(F.lit("user:"), (F.col("conv_id") % 5).cast("string")).alias("scope"), "text",
                          hash_embedding(F.col("text")).alias("vec"), F.lit("2024-02-01").cast("date").alias("date"), F.lit("").alias("subject"))
    found = recall(cut_lineage(inputs), nodes, links, names)["memories"]
    return found.select("query_id", F.col("id").alias("memory"), "seen", "rank", F.round("score", 6).alias("score"))


def carried_cues(cues: DataFrame, encounters: DataFrame, hours: float = 3, decay: float = 0.5) -> DataFrame:
    """What each encounter carries after its inputs: cues relative to the strongest of their input.

    cues: query_id, node, activation; encounters: query_id, scope, encounter, at.
    """
    best = cues.groupBy("query_id").agg(F.max("activation").alias("top"))
    updates = (cues.join(best, "query_id").join(encounters, "query_id")
               .select("scope", "encounter", F.col("query_id").alias("update_id"), "at", F.col("node").alias("cue"), (F.col("activation") / F.col("top")).alias("activation")))
    return memory.working_memory(updates, ["scope", "encounter"], hours=hours, decay=decay)
