"""Graph jobs on the shared tables: containment region > nation > customer > order > line, links order - part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import edge_id, stable_id
from ..operators import graph
from ..session import cut_lineage, drop_table
from .registry import query


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def tree_edges(t) -> DataFrame:
    """region > nation > customer > order."""
    return (t.nation.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
            .unionByName(t.customer.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")))
            .unionByName(t.orders.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"))))


TREE_SQL = """tree AS (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation UNION ALL
  SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL
  SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders)"""


@query("graph_neighbors", f"""WITH {TREE_SQL},
both_ways AS (SELECT src AS node, dst AS neighbour FROM tree UNION ALL SELECT dst, src FROM tree),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY neighbour) AS rank FROM both_ways WHERE node LIKE 'c:%')
SELECT node, neighbour, rank FROM ranked WHERE rank <= 5""")
def _neighbours(t):
    asked = t.customer.select(key("c", "c_custkey").alias("node"))
    return graph.neighbours(tree_edges(t), asked, 5)


@query("graph_degrees", """WITH e AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem),
b AS (SELECT src AS node, dst AS n FROM e UNION ALL SELECT dst, src FROM e),
d AS (SELECT node, count(DISTINCT n) AS degree FROM b GROUP BY node)
SELECT node, degree, round(1 / (1 + ln(greatest(1.0, degree / 5.0))), 6) AS specificity FROM d""")
def _degrees(t):
    edges = t.lineitem.select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"))
    return graph.degrees(edges).withColumn("specificity", F.round(graph.specificity(F.col("degree")), 6))


@query("graph_closure", f"""WITH RECURSIVE {TREE_SQL},
reach AS (SELECT 'r:' || r_regionkey AS start, 'r:' || r_regionkey AS node, 0 AS depth FROM region UNION
  SELECT start, dst, depth + 1 FROM reach JOIN tree ON node = src)
SELECT start, node, min(depth) AS depth FROM reach GROUP BY ALL""")
def _closure(t):
    starts = t.region.select(key("r", "r_regionkey").alias("start"), key("r", "r_regionkey").alias("node"))
    return graph.closure(starts, tree_edges(t))


@query("taxonomy_ancestors", f"""WITH RECURSIVE {TREE_SQL},
reach AS (SELECT 'c:' || c_custkey AS concept, 'c:' || c_custkey AS node, 0 AS depth FROM customer UNION
  SELECT concept, src, depth + 1 FROM reach JOIN tree ON node = dst)
SELECT concept, node AS ancestor, min(depth) AS depth FROM reach WHERE node NOT LIKE 'r:%' GROUP BY ALL""")
def _ancestors(t):
    edges = tree_edges(t).withColumn("relation", F.lit("BROADER_THAN"))
    origin = F.when(F.col("id").startswith("r:"), F.lit("OTHER")).otherwise(F.lit("MAIN"))
    nodes = (edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
             .select("id", F.lit("Concept").alias("kind"), origin.alias("origin")))
    return graph.taxonomy_ancestors(nodes, edges, t.customer.select(key("c", "c_custkey").alias("concept")), "MAIN")


CYCLE_SQL = f"""WITH RECURSIVE {TREE_SQL},
looped AS (SELECT * FROM tree UNION ALL SELECT 'c:' || min(c_custkey), 'r:' || min(n_regionkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_custkey = (SELECT min(c_custkey) FROM customer)),
back AS (SELECT src, dst FROM looped WHERE src LIKE 'c:%' AND dst LIKE 'r:%'),
reach AS (SELECT dst AS node FROM back UNION SELECT l.dst FROM reach JOIN looped l ON node = l.src)"""


@query("cycle_check", CYCLE_SQL + " SELECT node AS id FROM reach")
def _cycle(t):
    first = t.customer.agg(F.min("c_custkey").alias("c_custkey")).join(t.customer, "c_custkey").join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    back = first.select(key("c", "c_custkey").alias("src"), key("r", "n_regionkey").alias("dst"))
    return graph.cyclic_nodes(tree_edges(t).unionByName(back))


def line_node() -> Column:
    return F.concat(F.lit("l:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
                    F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))


def order_graph(t) -> DataFrame:
    """Suppliers provide orders, orders contain their lines."""
    numbers = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("__lines"))
    # Numbers travel, names are made behind the shuffle; lines that get the same name are one.
    order = key("o", "l_orderkey")
    def line(c):
        return F.concat(F.lit("l:"), F.col("l_orderkey").cast("string"), *[x for name in ("l_linenumber", "l_partkey", "l_suppkey") for x in (F.lit("-"), c[name].cast("string"))])
    def edge(src, dst, relation):
        return F.struct(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))
    provides = F.array_distinct(F.transform("__lines", lambda c: edge(F.concat(F.lit("s:"), c["l_suppkey"].cast("string")), order, "PROVIDES")))
    contains = F.array_distinct(F.transform("__lines", lambda c: edge(order, line(c), "CONTAINS")))
    return numbers.select(F.explode(F.concat(provides, contains)).alias("e")).select("e.src", "e.dst", "e.relation")


ORDER_GRAPH_SQL = """links AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'o:' || l_orderkey AS dst, 'PROVIDES' AS relation FROM lineitem UNION ALL
  SELECT DISTINCT 'o:' || l_orderkey, 'l:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'CONTAINS' FROM lineitem)"""


@query("provenance", f"""WITH {ORDER_GRAPH_SQL},
up AS (SELECT a.dst AS node, a.src AS doc, b.src AS source FROM links a LEFT JOIN links b ON b.dst = a.src AND b.relation = 'PROVIDES' WHERE a.relation = 'CONTAINS'),
section AS (SELECT a.dst AS node, min(concat_ws(' > ', 'r:' || n_regionkey, 'n:' || c_nationkey, 'c:' || o_custkey, a.src)) AS section FROM links a
  LEFT JOIN orders ON a.src = 'o:' || o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE a.relation = 'CONTAINS' GROUP BY 1),
line AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_returnflag AS f, 'l:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS node FROM lineitem),
against AS (SELECT DISTINCT a.node AS a, b.node AS b FROM line a JOIN line b ON a.o = b.o AND b.n = a.n + 1 WHERE a.f = 'A' AND b.f = 'R' AND a.node <> b.node),
other AS (SELECT x.node, count(DISTINCT x.other) AS contradictions, min(x.other) AS first_other, arg_min(s.section, x.other) AS other_section
  FROM (SELECT a AS node, b AS other FROM against UNION SELECT b, a FROM against) x JOIN section s ON s.node = x.other GROUP BY x.node),
counted AS (SELECT node, count(DISTINCT source) AS sources, count(DISTINCT doc) AS documents, min(source) AS first_source FROM up GROUP BY node)
SELECT node, sources, documents, first_source, section, coalesce(contradictions, 0) AS contradictions, first_other, other_section FROM counted JOIN section USING (node) LEFT JOIN other USING (node)""")
def _provenance(t):
    """Where each line comes from: suppliers, order, the way from its region down, and lines next to it that say the opposite."""
    places = tree_edges(t).withColumn("relation", F.lit("CONTAINS"))
    line = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"), line_node().alias("node")).distinct()
    following = line.where("f = 'R'").select("o", (F.col("n") - 1).alias("n"), F.col("node").alias("dst"))
    against = line.where("f = 'A'").join(following, ["o", "n"]).select(F.col("node").alias("src"), "dst", F.lit("CONTRADICTS").alias("relation")).distinct()
    orders = cut_lineage(order_graph(t))
    leaves = orders.where(F.col("relation") == "CONTAINS").select(F.col("dst").alias("id"))
    edges = orders.unionByName(places).unionByName(cut_lineage(against))
    source, document = F.col("ancestor").startswith("s:"), F.col("ancestor").startswith("o:")
    # Each of the three parts is written, so that what it moved leaves the disk before the next.
    counted = cut_lineage(graph.provenance(edges, leaves).groupBy("node").agg(
        F.count_if(source).alias("sources"), F.count_if(document).alias("documents"), F.min(F.when(source, F.col("ancestor"))).alias("first_source")))
    paths = cut_lineage(graph.section_paths(edges, leaves))
    section = paths.groupBy("node").agg(F.min(F.array_join("path", " > ")).alias("section"))
    other = cut_lineage(graph.contradicted(edges, leaves, paths).groupBy("node").agg(
        F.count_distinct("other").alias("contradictions"), F.min(F.struct("other", F.array_join("other_path", " > ").alias("section"))).alias("first")))
    drop_table(orders)
    return counted.join(section, "node").join(other, "node", "left").select(
        "node", "sources", "documents", "first_source", "section", F.coalesce("contradictions", F.lit(0)).alias("contradictions"), F.col("first.other").alias("first_other"), F.col("first.section").alias("other_section"))


@query("hard_delete", f"""WITH {ORDER_GRAPH_SQL},
docs AS MATERIALIZED (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
every AS MATERIALIZED (SELECT src, dst, relation FROM links),
emptied AS MATERIALIZED (SELECT src AS id FROM every LEFT JOIN docs ON dst = id WHERE relation = 'PROVIDES' GROUP BY src HAVING count(*) = count(id)),
inside AS MATERIALIZED (SELECT DISTINCT dst AS id FROM every JOIN docs ON src = id WHERE relation = 'CONTAINS'),
gone AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT id FROM docs UNION ALL SELECT id FROM inside UNION ALL SELECT id FROM emptied))
SELECT src, dst, relation FROM every LEFT JOIN gone a ON a.id = src LEFT JOIN gone b ON b.id = dst WHERE a.id IS NULL AND b.id IS NULL""")
def _delete(t):
    edges = cut_lineage(order_graph(t))  # the stored graph: read by the closure and by every step after it
    documents = t.orders.where(F.col("o_orderstatus") == "F").select(key("o", "o_orderkey").alias("document_id"))
    gone = graph.deletion_closure(edges, documents)
    nodes = edges.select(F.col("src").alias("id"))
    return graph.drop_nodes(nodes, edges, gone)[1]


@query("soft_forget", f"""WITH {ORDER_GRAPH_SQL},
docs AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
inside AS (SELECT id FROM docs UNION SELECT dst FROM links JOIN docs ON src = id WHERE relation = 'CONTAINS'),
nodes AS (SELECT DISTINCT dst AS id FROM links)
SELECT n.id, i.id IS NOT NULL AS excluded FROM nodes n LEFT JOIN inside i ON n.id = i.id""")
def _forget(t):
    edges = order_graph(t)
    nodes = edges.select(F.col("dst").alias("id")).distinct().withColumn("excluded", F.lit(False))
    documents = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(key("o", "o_orderkey").alias("document_id"))
    return graph.set_excluded(nodes, edges, documents)


@query("edge_rejects", """WITH nodes AS (SELECT 'o:' || o_orderkey AS id, 'Document' AS kind FROM orders UNION ALL
  SELECT 'p:' || p_partkey, 'Concept' FROM part WHERE p_size <= 25),
links AS (SELECT DISTINCT 'o:' || l_orderkey AS src, CASE WHEN l_linenumber = 7 THEN 'o:' || l_orderkey ELSE 'p:' || l_partkey END AS dst,
  CASE l_returnflag WHEN 'A' THEN 'ABOUT' WHEN 'R' THEN 'CONTAINS' ELSE 'MENTIONS' END AS relation FROM lineitem),
j AS (SELECT l.*, a.kind AS ak, b.kind AS bk FROM links l LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst)
SELECT src, dst, relation, CASE WHEN ak IS NULL OR bk IS NULL THEN 'dangling' ELSE 'endpoint_kinds' END AS reason FROM j
WHERE ak IS NULL OR bk IS NULL OR bk = 'Document' OR relation = 'CONTAINS'""")
def _rejects(t):
    nodes = (t.orders.select(key("o", "o_orderkey").alias("id"), F.lit("Document").alias("kind"))
             .unionByName(t.part.where(F.col("p_size") <= 25).select(key("p", "p_partkey").alias("id"), F.lit("Concept").alias("kind")))
             .withColumn("origin", F.lit("LOCAL")))
    relation = F.when(F.col("l_returnflag") == "A", F.lit("ABOUT")).when(F.col("l_returnflag") == "R", F.lit("CONTAINS")).otherwise(F.lit("MENTIONS"))
    dst = F.when(F.col("l_linenumber") == 7, key("o", "l_orderkey")).otherwise(key("p", "l_partkey"))
    edges = t.lineitem.select(key("o", "l_orderkey").alias("src"), dst.alias("dst"), relation.alias("relation")).distinct()
    return graph.edge_rejects(nodes, edges)


@query("edge_ids", """WITH links AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem),
h AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('lorekeep:edge:' || src || ':MENTIONS:' || dst)) AS d FROM links)
SELECT src, dst, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
  substr('89ab', cast('0x' || substr(d, 17, 1) AS INT) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS edge_id FROM h""")
def _edge_ids(t):
    edges = t.lineitem.select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst")).withColumn(
        "edge_id", edge_id(F.col("src"), F.lit("MENTIONS"), F.col("dst")))
    return edges.dropDuplicates(["edge_id"])


@query("merge_concepts", """WITH r AS (SELECT p_name AS id, p_type AS label, p_brand AS alias, p_size > 10 AS staged FROM part),
l AS (SELECT id, arg_min(label, (staged, label)) AS label FROM r GROUP BY id),
a AS (SELECT id, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM r GROUP BY id)
SELECT id, label, aliases FROM l JOIN a USING (id)""")
def _merge(t):
    nodes = t.part.select(F.col("p_name").alias("id"), F.lit("Concept").alias("kind"), F.col("p_type").alias("label"),
                          F.array("p_brand").alias("aliases"), F.lit("LOCAL").alias("origin"), "p_size")
    stored = nodes.where("p_size <= 10").groupBy("id").agg(
        F.first("kind").alias("kind"), F.min("label").alias("label"), F.array_sort(F.collect_set(F.col("aliases")[0])).alias("aliases"), F.first("origin").alias("origin"))
    merged = graph.merge_nodes(stored, nodes.where("p_size > 10").drop("p_size"))
    return merged.select("id", "label", F.array_join("aliases", "|").alias("aliases"))


@query("coalesced_upsert", """WITH r AS (SELECT o_custkey AS key, o_orderkey AS payload, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS vector,
  (o_orderdate, o_orderkey) AS v FROM orders)
SELECT key, arg_max(payload, v) AS payload, arg_max(vector, v) FILTER (vector IS NOT NULL) AS vector FROM r GROUP BY key""")
def _upsert(t):
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("payload"),
                           F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("vector"), F.col("o_orderdate").alias("at"))
    early = F.year("at") < 1997
    merged = graph.upsert(rows.where(early), rows.where(~early), ["key"], F.struct("at", "payload"), ["vector"])
    return merged.select("key", "payload", "vector")


@query("record_scan", """SELECT key, event_type AS category, value FROM (SELECT lpad(user_id::VARCHAR, 6, '0') || ':' || lpad(event_id::VARCHAR, 9, '0') AS key, * FROM events)
WHERE event_type = 'click' AND starts_with(key, '0000') AND key > '000020:'""")
def _scan(t):
    rows = t.events.select(F.concat(F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("key"),
                           F.col("event_type").alias("category"), "value")
    return graph.records_after(rows, "click", "0000", "000020:")


@query("scope_visibility", """WITH about AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity >= 49),
nodes AS (SELECT 'd:' || doc_id AS id, source AS scope, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS excluded, 'LOCAL' AS origin FROM documents UNION ALL
  SELECT 'p:' || p_partkey, 'shared', false, CASE WHEN p_size <= 20 THEN 'LOCAL' ELSE 'MAIN' END FROM part)
SELECT id, scope FROM nodes WHERE scope IN ('shared', 'src3', 'src7') AND NOT excluded
  AND (origin = 'LOCAL' OR id IN (SELECT 'p:' || p FROM about))""")
def _visible(t):
    toxic = t.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("excluded"))
    docs = t.documents.select("doc_id", "source").join(toxic, "doc_id", "left").select(
        key("d", "doc_id").alias("id"), F.lit("Document").alias("kind"), F.col("source").alias("scope"), "excluded", F.lit("LOCAL").alias("origin"))
    parts = t.part.select(key("p", "p_partkey").alias("id"), F.lit("Concept").alias("kind"), F.lit("shared").alias("scope"), F.lit(False).alias("excluded"),
                          F.when(F.col("p_size") <= 20, F.lit("LOCAL")).otherwise(F.lit("MAIN")).alias("origin"))
    edges = t.lineitem.where("l_quantity >= 49").select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("ABOUT").alias("relation"))
    nodes = docs.unionByName(parts).where(graph.visible(F.col("scope"), F.col("excluded"), ["shared", "src3", "src7"]))
    return graph.content_nodes(nodes, edges).select("id", "scope")


@query("document_ids", """WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
k AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('lorekeep:document:1:text/plain:' || content_hash)) AS d FROM h)
SELECT doc_id, content_hash, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
  substr('89ab', cast('0x' || substr(d, 17, 1) AS INT) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS document_id FROM k""")
def _ids(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return rows.withColumn("document_id", stable_id("document", F.concat(F.lit("1:text/plain:"), "content_hash")))
