"""Checks of what changes stored knowledge: sessions that come again, resumed runs, forgetting, erasure and re-coding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import arms, clinical, concepts, forgetting, patients, recoding, sessions
from ..session import cut_folder, cut_lineage, drop_table
from ..sources import imports, taxonomies, versions
from .graphs import key
from .recall import trade_links
from .search import STOP_SQL, WORDS_SQL
from .registry import query
from .terminologies import APPLY_SQL, RF2_BASE, order_records, part_release, part_relations


def _fresh(t, name: str) -> str:
    return f"{cut_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- Sessions ---
@query("session_store", """WITH c AS (SELECT 'user:' || conv_id % 5 AS scope, conv_id AS session, turn, text FROM conversations)
SELECT scope, session, turn, text, 10 AS at FROM c WHERE session % 4 NOT IN (1, 3) AND session % 10 <> 4 UNION ALL
SELECT scope, session, turn, 'new', 30 FROM c WHERE session % 4 = 1 AND turn % 2 = 0 UNION ALL
SELECT scope, session, turn, 'late', 20 FROM c WHERE session % 4 = 3 AND turn = 0""")
def _store(t):
    """Four deliveries: all sessions, some again at 30, more at 20 that arrive late, and some that come again without rows."""
    rows = t.conversations.select(F.concat(F.lit("user:"), (F.col("conv_id") % 5).cast("string")).alias("scope"), F.col("conv_id").alias("session"), "turn", "text")
    log = versions.KeyedLog(t.spark, _fresh(t, "sessions"), ["scope", "session"], "scope string, session long, turn long, text string")
    log.append(rows, 10)
    log.append(rows.where("session % 4 = 1 and turn % 2 = 0").withColumn("text", F.lit("new")), 30)
    log.compact()
    log.append(rows.where("session % 2 = 1 and turn = 0").withColumn("text", F.lit("late")), 20)
    log.append(rows.limit(0), 40, rows.where("session % 10 = 4").select("scope", "session").distinct())
    return log.current(versions=True).select("scope", "session", "turn", "text", F.col("_at").cast("int").alias("at"))


@query("resumed_run", """SELECT page_id AS qid, CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN page_id % 7 = 0 THEN 3 WHEN page_id % 7 = 1 THEN 1 ELSE 0 END AS failures,
  CASE WHEN page_id % 7 <> 0 THEN length(html) END AS chars FROM pages""")
def _run(t):
    """A run over all pages, resumed until nothing is pending: some pages fail always, others at first, and one batch dies before it counts."""
    work = t.pages.select(F.col("page_id").alias("qid"), "html")
    log = versions.KeyedLog(t.spark, _fresh(t, "run"), ["qid"], "qid long, status string, failures int, chars int")

    def measured(rows):
        bad = (F.col("qid") % 7 == 0) | ((F.col("qid") % 7 == 1) & (F.col("failures") == 0))
        return rows.select("qid", "failures", F.when(bad, "failed").otherwise("done").alias("status"), F.when(~bad, F.length("html")).alias("chars"))

    versions.resume(work.where("qid % 2 = 0"), log, measured, 1)
    lost = measured(versions.pending(work, log))
    log._write(lost.withColumn("_at", F.lit(2.0)).withColumn("status", F.lit("done")), lost.select("qid", F.lit(2.0).alias("_at")))  # dies before its line is written
    for moment in range(3, 7):
        versions.resume(work, log, measured, moment)
    return log.current().select("qid", "status", "failures", "chars")


SESSION_SQL = """c AS MATERIALIZED (SELECT 'u' || o_custkey % 3 AS scope, o_orderkey AS session, l_linenumber AS n, 'line ' || l_linenumber || ' of ' || l_partkey AS txt, 'part ' || l_partkey AS entity,
  CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 END AS round, 'size ' || p_size AS cat, o_orderstatus = 'F' AS episode FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
v AS (SELECT * FROM c WHERE NOT (session % 4 = 1 AND n > 2)),
m AS MATERIALIZED (SELECT DISTINCT scope, session, 'm:' || left(sha1(session || '|' || txt), 12) AS node, 'e:' || entity AS entity, 'e:' || cat AS cat, 's:' || session AS s, 'r:' || session || ':' || round AS r, round, episode FROM v),
x AS (SELECT scope, session, s AS a, r AS b, 'round' AS kind, 0 AS rank FROM m WHERE round IS NOT NULL UNION ALL SELECT scope, session, CASE WHEN round IS NULL THEN s ELSE r END, node, 'memory', 1 FROM m
  UNION ALL SELECT scope, session, node, entity, 'entity', 2 FROM m UNION ALL SELECT scope, session, entity, cat, 'category', 3 FROM m
  UNION ALL SELECT DISTINCT scope, session, 's:' || session, 'm:' || session || ':episode', 'episode', 4 FROM c WHERE episode UNION ALL SELECT scope, session, 'm:' || session || ':episode', entity, 'episode', 4 FROM m WHERE episode),
g AS MATERIALIZED (SELECT scope, least(a, b) AS a, greatest(a, b) AS b, arg_max(kind, (session, rank)) AS kind FROM x GROUP BY 1, 2, 3),
d AS MATERIALIZED (SELECT scope, node, count(*) AS degree FROM (SELECT scope, a AS node FROM g UNION ALL SELECT scope, b FROM g) GROUP BY ALL)"""


def order_sessions(t):
    """Orders as sessions: a memory per line that names its part, parts with their size as category, an episode for finished orders."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_partkey").cast("string"))
    name = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    turn = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") % 3)
    memory = F.struct(F.col("l_linenumber").alias("n"), text.alias("text"), F.array(name).alias("entities"), turn.alias("round"))
    entity = F.struct(name.alias("name"), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("is_a"), F.col("l_linenumber").alias("n"))
    gathered = lines.groupBy(F.col("l_orderkey").alias("session")).agg(F.sort_array(F.collect_list(memory)).alias("memories"), F.collect_list(entity).alias("entities"))
    episode = F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("finished").alias("title"), F.lit("An order was finished.").alias("text")))
    return t.orders.select(F.concat(F.lit("u"), (F.col("o_custkey") % 3).cast("string")).alias("scope"), F.col("o_orderkey").alias("session"), episode.alias("episode")).join(gathered, "session")


@query("session_graph", f"WITH {SESSION_SQL} SELECT g.scope, g.a, g.b, g.kind, da.degree AS degree_a, db.degree AS degree_b FROM g JOIN d da ON da.scope = g.scope AND da.node = a JOIN d db ON db.scope = g.scope AND db.node = b")
def _graph(t):
    """Links of all sessions, then of a second delivery that cuts every fourth session to two lines; degrees follow by difference."""
    first = cut_lineage(order_sessions(t))
    links = cut_lineage(sessions.session_links(first))  # the stored table that the second delivery changes
    # Every step is written and what it no longer needs dropped, so that disk holds one step's shuffles and tables.
    pairs = cut_lineage(sessions.session_graph(links))
    degrees = cut_lineage(sessions.node_degrees(pairs))
    drop_table(pairs)
    again = first.where("session % 4 = 1").withColumn("memories", F.filter("memories", lambda m: m["n"] <= 2)).withColumn("entities", F.filter("entities", lambda e: e["n"] <= 2))
    stored = links
    links, shift = sessions.replaced_links(stored, again)
    drop_table(stored)
    drop_table(first)
    after = cut_lineage(sessions.shifted(degrees, shift).select("scope", "node", "degree"))
    graph = sessions.session_graph(links)
    for end in ("b", "a"):
        graph = graph.join(after.select("scope", F.col("node").alias(end), F.col("degree").alias(f"degree_{end}")), ["scope", end], "left")
        if end == "b":
            graph = cut_lineage(graph)
            drop_table(links)
    return graph.select("scope", "a", "b", "kind", "degree_a", "degree_b")


# --- Forgetting ---
@query("forget_memories", """WITH o AS (SELECT 'u' || o_custkey % 3 AS scope, o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
k AS (SELECT * FROM o WHERE id % 40 = 1), p AS (SELECT DISTINCT scope, l_partkey FROM k JOIN lineitem ON l_orderkey = id),
b AS (SELECT DISTINCT scope, p_size || ' ' || p_brand AS box, p_brand FROM p JOIN part ON p_partkey = l_partkey)
SELECT scope, 'memory' AS kind, id::VARCHAR AS name FROM k UNION ALL SELECT scope, 'entity', 'part ' || l_partkey FROM p UNION ALL SELECT scope, 'entity', 'box ' || box FROM b
UNION ALL SELECT DISTINCT scope, 'entity', 'container ' || p_brand FROM b UNION ALL SELECT scope, 'forgotten', count(*)::VARCHAR FROM o WHERE id % 40 <> 1 GROUP BY scope""")
def _forget(t):
    """All but every fortieth order is forgotten; parts fall with their last order, boxes with their last part, containers with their last box."""
    scope = F.concat(F.lit("u"), (F.col("o_custkey") % 3).cast("string")).alias("scope")
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    ordered = cut_lineage(t.orders.select(scope, F.col("o_orderkey").alias("id")).join(t.lineitem.select(F.col("l_orderkey").alias("id"), "l_partkey", part.alias("part")), "id"))
    memories = ordered.groupBy("scope", "id").agg(F.collect_set("part").alias("entities"))
    box = F.concat(F.lit("box "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand"))
    container = F.concat(F.lit("container "), F.col("p_brand"))
    parts = ordered.select("scope", "l_partkey", "part").distinct().join(t.part.select(F.col("p_partkey").alias("l_partkey"), box.alias("box"), container.alias("container")), "l_partkey")
    entities = (parts.select("scope", F.col("part").alias("name"), F.array("box").alias("is_a"))
                .unionByName(parts.select("scope", F.col("box").alias("name"), F.array("container").alias("is_a")).distinct())
                .unionByName(parts.select("scope", F.col("container").alias("name"), F.array().cast("array<string>").alias("is_a")).distinct()))
    kept, left, count = forgetting.forget_memories(memories, cut_lineage(entities), ordered.where("id % 40 <> 1").select("scope", "id"))
    return (kept.select("scope", F.lit("memory").alias("kind"), F.col("id").cast("string").alias("name")).unionByName(left.select("scope", F.lit("entity").alias("kind"), "name"))
            .unionByName(count.select("scope", F.lit("forgotten").alias("kind"), F.col("forgotten").cast("string").alias("name"))))


@query("clinical_erasure", f"WITH {APPLY_SQL.replace('ON p_partkey = l_partkey)', 'ON p_partkey = l_partkey WHERE o_custkey % 7 <> 0 AND o_orderkey % 5 <> 0)')} SELECT patient, state, code FROM facts")
def _erase(t):
    """Every seventh patient and every fifth document of the others is erased, and the guidelines of some brands."""
    records, relations = cut_lineage(order_records(t)), part_relations(t)
    own = records.withColumn("scope", F.concat(F.lit("patient:"), F.col("patient").cast("string"))).withColumn("document_id", F.col("memory_id"))
    guideline = (t.part.select(F.col("p_brand").alias("document_id")).distinct().withColumns(
        {"scope": F.lit("shared"), "source": F.lit("guideline")}))
    memories = own.unionByName(guideline, allowMissingColumns=True)
    wanted = (own.where("patient % 7 = 0").select("scope", F.lit(None).cast("string").alias("document_id")).distinct()
              .unionByName(own.where("cast(document_id as long) % 5 = 0").select("scope", "document_id")).unionByName(guideline.where("document_id like '%1'").select("scope", "document_id")))
    return forgetting.erase_clinical(memories, clinical.patient_facts(records, relations), relations, wanted)[1]


# --- Re-coding ---
RECODE_SQL = f"""{RF2_BASE}, named AS (SELECT p_name, max(code) AS code FROM p GROUP BY p_name),
e AS (SELECT l_orderkey AS memory_id, l_linenumber AS place, CASE p_size % 3 WHEN 0 THEN 'sct:' || named.code WHEN 1 THEN 'sct:' || p.code ELSE 'txt:zz' || p_size END AS key,
  CASE p_size % 3 WHEN 0 THEN 'txt:' || p.p_name WHEN 1 THEN 'sct:' || p.code ELSE 'txt:zz' || p_size END AS old, CASE p_size % 3 WHEN 0 THEN 'txt:' || p.p_name END AS was FROM lineitem JOIN p ON p_partkey = l_partkey JOIN named ON named.p_name = p.p_name)"""


def order_concepts(t):
    """Orders as memories: a third of the parts known by code, a third by their name only, a third by words no terminology has."""
    code = F.concat(F.lit("sct:1"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    word = F.concat(F.lit("zz"), F.col("p_size").cast("string"))
    kind = F.col("p_size") % 3
    concept = F.struct(F.col("l_linenumber").alias("place"), F.when(kind == 0, F.concat(F.lit("txt:"), "p_name")).when(kind == 1, code).otherwise(F.concat(F.lit("txt:"), word)).alias("key"),
                       F.when(kind == 2, word).otherwise(F.col("p_name")).alias("term"), F.lit("").alias("tag"), F.lit(None).cast("string").alias("was"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("memory_id")).agg(F.sort_array(F.collect_list(concept)).alias("c"))
    return rows.select("memory_id", F.transform("c", lambda c: F.struct(c["key"], c["term"], c["tag"], c["was"])).cast(recoding.CONCEPT).alias("concepts"))


def _recoded(t):
    release, descriptions, _, relationships = part_release(t)
    concept, term, relation = taxonomies.terminology(release, descriptions, relationships)
    # Wordings, changes, links and codes all read the memories: written once, the order lines are joined and grouped once.
    memories = cut_lineage(order_concepts(t))
    after, touched = recoding.recode(memories, recoding.recodable(memories, term, concept))
    return memories, after, touched, relation


@query("recoded_memories", f"WITH {RECODE_SQL} SELECT memory_id, string_agg(key, '|' ORDER BY place, old) AS keys, coalesce(string_agg(was, '|' ORDER BY place, old), '') AS was FROM e GROUP BY memory_id")
def _recode(t):
    after = _recoded(t)[1]
    return after.select("memory_id", F.array_join(F.transform("concepts", lambda c: c["key"]), "|").alias("keys"), F.array_join(F.transform("concepts", lambda c: c["was"]), "|").alias("was"))


@query("recoded_degrees", f"WITH {RECODE_SQL} SELECT key AS node, count(DISTINCT memory_id) AS degree FROM e GROUP BY key UNION ALL SELECT memory_id::VARCHAR, count(DISTINCT key) FROM e GROUP BY memory_id")
def _recode_degrees(t):
    """Degrees of memories and concepts, shifted by what the re-coding changes only."""
    memories, after, touched, _ = _recoded(t)
    named = memories.withColumn("memory_id", F.col("memory_id").cast("string"))
    links = cut_lineage(recoding.concept_links(named))
    before = links.select(F.explode(F.array("memory", "concept")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    shift = recoding.relinked(links, after.withColumn("memory_id", F.col("memory_id").cast("string")), touched.select(F.col("memory_id").cast("string")))[1]
    return recoding.shifted_degrees(before, shift).select("node", "degree")


@query("recoded_closure", f"WITH {RECODE_SQL}, c AS (SELECT DISTINCT substr(key, 5) AS code FROM e WHERE key LIKE 'sct:%') SELECT code, unnest([code, brand, '138875005']) AS ancestor FROM c JOIN p USING (code)")
def _recode_closure(t):
    """Ancestors of the codes in use: those known before as stored, the codes that came by re-coding added."""
    memories, after, _, relation = _recoded(t)
    def codes(rows):
        return rows.select(F.explode("concepts").alias("c")).where(F.col("c.key").startswith("sct:")).select(clinical.code_of("c.key").alias("code")).distinct()
    return recoding.extended_closure(clinical.ancestor_closure(relation, codes(memories)), relation, codes(after))


# --- Taxonomy import ---
MOVED_SQL = """now AS (SELECT 'c' || c_custkey AS child, 'n' || CASE WHEN c_custkey % 10 = 3 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS parent FROM customer WHERE c_custkey % 10 <> 7
  UNION ALL SELECT 'n' || n_nationkey, 'r' || CASE WHEN n_nationkey = 4 THEN 0 ELSE n_regionkey END FROM nation UNION ALL SELECT 's' || s_suppkey, 'c' || c FROM (SELECT s_suppkey, 10 * s_suppkey + 1 AS c FROM supplier) WHERE c IN (SELECT c_custkey FROM customer)),
ids AS (SELECT child AS id FROM now UNION SELECT parent FROM now)"""


def _tree(t, moved: bool):
    """Regions, nations and customers as a taxonomy; moved: some customers and one nation elsewhere, some gone, suppliers below customers."""
    name = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    nation, region, customers = F.col("c_nationkey"), F.col("n_regionkey"), t.customer
    links = []
    if moved:
        nation = F.when(F.col("c_custkey") % 10 == 3, (nation + 1) % 25).otherwise(nation)
        region = F.when(F.col("n_nationkey") == 4, 0).otherwise(region)
        customers = customers.where("c_custkey % 10 <> 7")
        under = t.supplier.select(name("s", F.col("s_suppkey")).alias("dst"), (10 * F.col("s_suppkey") + 1).alias("c_custkey")).join(customers.select("c_custkey"), "c_custkey")
        links = [under.select(name("c", F.col("c_custkey")).alias("src"), "dst")]
    edges = customers.select(name("n", nation).alias("src"), name("c", F.col("c_custkey")).alias("dst")).unionByName(
        t.nation.select(name("r", region).alias("src"), name("n", F.col("n_nationkey")).alias("dst")))
    for more in links:
        edges = edges.unionByName(more)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select(
        "id", F.lit("Concept").alias("kind"), F.lit("TREE").alias("origin"), F.concat(F.lit("urn:"), "id").alias("uri"), F.col("id").alias("label"))
    return nodes, edges.withColumns({"relation": F.lit("BROADER_THAN"), "authority": F.lit("TREE")})


@query("taxonomy_import", f"""WITH RECURSIVE {MOVED_SQL}, reach AS (SELECT id AS concept, id AS ancestor FROM ids UNION SELECT concept, parent FROM reach JOIN now ON child = ancestor)
SELECT concept, ancestor, 'imported same refused migrated' AS outcomes FROM reach""")
def _import(t):
    """The same snapshot twice, then a changed one: refused, and taken as a migration; the closure follows by difference."""
    outcomes = []
    outcome, stored = imports.import_taxonomy(None, *_tree(t, False), "TREE")
    outcomes.append(outcome)
    outcome, stored = imports.import_taxonomy(stored, *_tree(t, False), "TREE")
    outcomes.append(outcome)
    try:
        imports.import_taxonomy(stored, *_tree(t, True), "TREE")
    except imports.Refused:
        outcomes.append("refused")
    outcome, stored = imports.import_taxonomy(stored, *_tree(t, True), "TREE", migrate=True)
    outcomes.append(outcome)
    return stored["closure"].select("concept", "ancestor", F.lit(" ".join(outcomes)).alias("outcomes"))


# --- Arms ---
ARM_SPECS = ["wide", "narrow[top_k=3;fan0=10;decay=0.5]", "short[hops=1;IN_SESSION=0.8]", "strict[threshold=0.12;MENTIONS=0.5]"]
ARMS_SQL = """one AS (SELECT DISTINCT 'c:' || o_custkey AS a, 'o:' || o_orderkey AS b, false AS line FROM orders UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, true FROM lineitem),
l AS (SELECT a AS node, b AS nb, line FROM one UNION ALL SELECT b, a, line FROM one), deg AS (SELECT node, count(*) AS degree FROM l GROUP BY node),
arms(arm, hops, decay, k, thr, fan0, wo, wl) AS (VALUES ('wide', 2, 0.6, 8, 0.05, 5, 0.3, 1.0), ('narrow[top_k=3;fan0=10;decay=0.5]', 2, 0.5, 3, 0.05, 10, 0.3, 1.0),
  ('short[hops=1;IN_SESSION=0.8]', 1, 0.6, 8, 0.05, 5, 0.8, 1.0), ('strict[threshold=0.12;MENTIONS=0.5]', 2, 0.6, 8, 0.12, 5, 0.3, 0.5)),
seeds AS (SELECT DISTINCT c_nationkey AS query_id, 'c:' || c_custkey AS seed FROM customer),
h1 AS (SELECT arm, query_id, seed, l.nb AS node, decay * (1 / (1 + ln(greatest(1.0, degree / fan0::DOUBLE)))) * CASE WHEN line THEN wl ELSE wo END AS gain,
  row_number() OVER (PARTITION BY arm, query_id, seed ORDER BY CASE WHEN line THEN wl ELSE wo END DESC, nb DESC) AS r FROM arms, seeds JOIN l ON l.node = seed JOIN deg ON deg.node = seed QUALIFY r <= k),
r1 AS (SELECT arm, query_id, node, sum(gain) AS a, arg_min(seed, (-gain, seed)) AS parent FROM h1 GROUP BY ALL),
h2 AS (SELECT r.arm, r.query_id, l.nb AS node, r.a * decay * (1 / (1 + ln(greatest(1.0, degree / fan0::DOUBLE)))) * CASE WHEN line THEN wl ELSE wo END AS gain,
  row_number() OVER (PARTITION BY r.arm, r.query_id, r.node ORDER BY CASE WHEN line THEN wl ELSE wo END DESC, nb DESC) AS rk
  FROM r1 r JOIN arms USING (arm) JOIN l ON l.node = r.node JOIN deg ON deg.node = r.node WHERE hops > 1 AND r.a >= thr AND l.nb <> r.parent QUALIFY rk <= k)"""


@query("arms", f"""WITH {ARMS_SQL} SELECT arm, query_id, node, round(sum(a), 6) AS activation FROM (SELECT arm, query_id, seed AS node, 1.0 AS a FROM arms, seeds UNION ALL SELECT arm, query_id, node, a FROM r1
UNION ALL SELECT arm, query_id, node, gain FROM h2) GROUP BY arm, query_id, node""")
def _arms(t):
    """Four arms of associative recall in one pass over the links of customers, orders and parts."""
    seeds = t.customer.select(F.col("c_nationkey").alias("query_id"), key("c", "c_custkey").alias("node"), F.lit(1.0).alias("activation"), key("c", "c_custkey").alias("why"))
    table = arms.arm_table(t.spark, ARM_SPECS).withColumn("max_nodes", F.lit(1_000_000))
    links = trade_links(t)
    found = arms.spread_arms(seeds, links, table).select("arm", "query_id", "node", F.round("activation", 6).alias("activation"))
    drop_table(links)  # the operator has written what it takes of them
    return found


# --- Concepts that are nearly there ---
@query("fuzzy_resolution", f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
p AS (SELECT part.*, embedding::DOUBLE[] AS e FROM part, n JOIN embeddings ON vec_id = p_partkey % n.n),
k AS (SELECT 'k' || p_partkey AS id, lower(p_name) AS label, CASE WHEN p_size <= 5 THEN lower(p_name || ' ' || p_brand) END AS alias, {WORDS_SQL.format("p_name || ' ' || CASE WHEN p_size <= 5 THEN p_name || ' ' || p_brand ELSE '' END")} AS w, e
  FROM p WHERE p_size <= 10 AND p_partkey % 4 = 0),
s AS (SELECT p_partkey::VARCHAR AS spec_id, lower(p_name || ' ' || p_brand) AS label, {WORDS_SQL.format("p_name || ' ' || p_brand || ' ' || p_type")} AS w0, e FROM p),
x AS (SELECT label, min(id) AS id FROM (SELECT alias AS label, id FROM k WHERE alias IS NOT NULL UNION ALL SELECT label, id FROM k) GROUP BY label),
lead AS (SELECT s.label, arg_min(spec_id, spec_id) AS spec_id FROM s WHERE label NOT IN (SELECT label FROM x) GROUP BY s.label),
q AS (SELECT s.*, list_filter(w0, lambda y: y NOT IN ({STOP_SQL})) AS w FROM s JOIN lead USING (spec_id)),
c AS (SELECT q.label, k.id, round(0.6 * len(list_intersect(q.w, k.w)) / len(q.w) + 0.35 * greatest(list_cosine_similarity(q.e, k.e), 0), 9) AS score FROM q, k),
b AS (SELECT label, arg_min(id, (-score, id)) AS id, max(score) AS score FROM c WHERE score >= 0.2 GROUP BY label)
SELECT s.spec_id, coalesce(x.id, b.id) AS concept_id, x.id IS NULL AND b.id IS NULL AS is_new, round(b.score, 6) AS score FROM s LEFT JOIN x USING (label) LEFT JOIN b USING (label)""")
def _fuzzy(t):
    """Parts by name and brand against a tenth of them as stored concepts, some with the brand among their aliases."""
    vectors = t.embeddings.agg(F.count(F.lit(1))).scalar()
    rows = t.part.withColumn("vec_id", F.col("p_partkey") % vectors).join(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), "vec_id")
    rows = cut_lineage(rows)  # specs and stored concepts, each read by several steps
    label, none = F.concat_ws(" ", "p_name", "p_brand"), F.array().cast("array<string>")
    specs = rows.select(F.col("p_partkey").cast("string").alias("spec_id"), label.alias("label"), none.alias("aliases"), F.col("p_type").alias("description"), "vec")
    stored = rows.where("p_size <= 10 and p_partkey % 4 = 0").select(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") <= 5, F.array(label)).otherwise(none).alias("aliases"),
        F.lit("MAIN").alias("origin"), *[F.lit("").alias(c) for c in ("routing_summary", "summary", "text")], F.col("vec").alias("embedding"), F.lit(0).alias("hits"))
    found = concepts.resolve_with_candidates(specs, stored)
    return found.select("spec_id", F.when(~F.col("is_new"), F.col("concept_id")).alias("concept_id"), "is_new", F.round("score", 6).alias("score"))


# --- Patients' questions ---
@query("patient_ask", f"""WITH {APPLY_SQL},
lines AS (SELECT o_custkey AS patient, brand, code, o_orderkey AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN p ON p_partkey = l_partkey),
scored AS (SELECT patient, brand AS rec_id, (count(*) * 7 + brand::INT % 5 + 1) / (7.0 * sum(count(*)) OVER (PARTITION BY patient) + 10) AS score FROM lines GROUP BY patient, brand),
recs AS (SELECT brand AS rec_id, max(code) AS last_part, min(code) AS first_part FROM p GROUP BY brand),
has AS (SELECT patient, code, bool_or(state = 'present') AS pr, bool_or(state = 'possible') AS po, bool_or(state = 'absent') AS ab FROM facts GROUP BY ALL),
fit AS (SELECT s.patient, s.rec_id, s.score, CASE WHEN e.pr THEN 0.0 ELSE CASE WHEN b.pr THEN 1.0 WHEN b.ab THEN 0.05 WHEN b.po THEN 0.6 ELSE 0.2 END
  * CASE WHEN c.pr THEN 1.0 WHEN c.ab THEN 0.05 WHEN c.po THEN 0.6 ELSE 0.2 END END AS factor FROM scored s JOIN recs r USING (rec_id)
  LEFT JOIN has b ON b.patient = s.patient AND b.code = r.rec_id LEFT JOIN has c ON c.patient = s.patient AND c.code = r.last_part LEFT JOIN has e ON e.patient = s.patient AND e.code = r.first_part),
g AS (SELECT patient, rec_id, row_number() OVER (PARTITION BY patient ORDER BY round(score * factor, 4) DESC, rec_id) AS n FROM fit WHERE factor > 0 QUALIFY n <= 6),
m AS (SELECT DISTINCT o_custkey AS patient, o_orderkey::VARCHAR AS id, o_orderdate::DATE AS d, o_orderstatus AS st FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
pm AS (SELECT patient, id, row_number() OVER (PARTITION BY patient ORDER BY d DESC, id) AS n FROM m QUALIFY n <= 12),
h AS (SELECT patient, id, row_number() OVER (PARTITION BY patient ORDER BY id) AS n FROM m WHERE st = 'F'),
block AS (SELECT patient, 'G' || n AS label, rec_id AS memory_id FROM g UNION ALL SELECT patient, 'P' || n, id FROM pm UNION ALL SELECT patient, 'H' || n, id FROM h),
cited AS (SELECT DISTINCT patient, memory_id FROM block WHERE label IN ('P2', 'G1', 'H3'))
SELECT block.patient AS query_id, label, block.memory_id, cited.memory_id IS NOT NULL AS cited FROM block LEFT JOIN cited USING (patient, memory_id)""")
def _patient_ask(t):
    """Every customer asks: finished orders are the header, the latest orders the statements, brands the recommendations."""
    records, relations = cut_lineage(order_records(t)), part_relations(t)
    code = F.concat(F.lit("1"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    brand = F.concat(F.lit("9"), F.regexp_extract("p_brand", r"(\d+)", 1))
    codes = t.part.select("p_partkey", code.alias("code"), brand.alias("rec_id"))
    item = lambda c: F.struct(F.concat(F.lit("sct:"), c).alias("key"), F.col(c).alias("term"))
    recs = codes.groupBy("rec_id").agg(F.max("code").alias("last"), F.min("code").alias("first")).select(
        "rec_id", F.array(item("rec_id"), item("last")).alias("conditions"), F.array(item("first")).alias("exclusions"), F.lit("text").alias("text"), F.lit("brands").alias("guideline"), F.lit("").alias("strength"))
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(codes, F.col("p_partkey") == F.col("l_partkey"))
    counts = lines.groupBy(F.col("o_custkey").alias("query_id"), "rec_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("query_id").agg(F.sum("n").alias("all"))
    scored = counts.join(totals, "query_id").select("query_id", "rec_id", ((F.col("n") * 7 + F.col("rec_id").cast("int") % 5 + 1) / (7.0 * F.col("all") + 10)).alias("score"))
    ranked = records.select(F.col("patient").alias("query_id"), "memory_id", F.unix_date("date").alias("score"))
    finished = records.where("state = 'present'").withColumn("header", F.lit("results"))
    header = clinical.patient_header(clinical.header_slots(finished, relations, [], []), [])
    asked = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_custkey").alias("patient")).distinct()
    block = cut_lineage(patients.patient_ask(asked, ranked, scored, header, records, recs, clinical.patient_facts(records, relations)))
    answers = asked.select("query_id", F.lit("As P2 says, [G1] holds; so does H3, but not X1 or G77. P2 again.").alias("answer"))
    cited = patients.cited_statements(answers, block).select("query_id", "memory_id", F.lit(True).alias("cited"))
    return block.join(cited, ["query_id", "memory_id"], "left").select("query_id", "label", "memory_id", F.coalesce("cited", F.lit(False)).alias("cited"))


@query("guideline_listing", """SELECT n_name AS document_id, n_regionkey % 2 AS failed_sections, count(s_suppkey) AS recommendations FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 3 = 0 GROUP BY ALL""")
def _guidelines(t):
    documents = t.nation.select(F.col("n_name").alias("document_id"), "n_nationkey", (F.col("n_regionkey") % 2).alias("failed_sections"))
    recommendations = t.supplier.where("s_suppkey % 3 = 0").join(documents, F.col("s_nationkey") == F.col("n_nationkey")).select("document_id", "s_suppkey")
    return patients.guideline_listing(documents.drop("n_nationkey"), recommendations)
