"""Checks of the smaller operators: lookups, deletes, projections, filters, ids, texts, samples and upkeep rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, ids, text, vectors
from ..operators import concepts, evaluation, fusion, graph, inference, memory
from ..sources import conversations
from .registry import query


@query("node_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def _lookup(t):
    asked = t.lineitem.where("l_quantity = 1").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return graph.lookup(t.part, asked, "p_partkey").select("p_partkey", "p_name")


@query("record_delete", "SELECT o_orderstatus AS category, o_orderkey::VARCHAR AS key FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey::VARCHAR LIKE '1%')")
def _delete(t):
    return graph.delete_records(t.orders.select(F.col("o_orderstatus").alias("category"), F.col("o_orderkey").cast("string").alias("key")), "F", "1")


@query("erased_scope", "SELECT 'user:' || user_id % 5 AS scope, count(*) AS n FROM events WHERE user_id % 5 <> 3 GROUP BY ALL")
def _erase(t):
    rows = t.events.select(F.concat(F.lit("user:"), (F.col("user_id") % 5).cast("string")).alias("scope"))
    return graph.erase_scope(rows, "user:3").groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("node_previews", r"""SELECT doc_id::VARCHAR AS node_id, length(text) > 0 AS retrievable, md5(CASE WHEN len(regexp_extract_all(text, '\S+')) <= 80 THEN text
  ELSE array_to_string(regexp_extract_all(text, '\s*\S+')[1:80], '') END) AS excerpt FROM documents""")
def _previews(t):
    nodes = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("label"), F.lit("Document").alias("kind"), F.lit("LOCAL").alias("origin"),
                               F.lit("").alias("routing_summary"), F.array().cast("array<string>").alias("aliases"), "text", F.lit(True).alias("retrieval_leaf"))
    return graph.previews(nodes).select("node_id", "retrievable", F.md5("excerpt").alias("excerpt"))


@query("node_projection", "SELECT p_partkey AS id, lower(p_name) AS label_key, lower(p_brand) AS alias, false AS excluded FROM part")
def _projection(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("label"), F.array("p_brand").alias("aliases"), F.lit(None).cast("boolean").alias("excluded"),
                          F.array(F.lit(1.0)).alias("embedding"))
    return graph.node_projection(nodes).select("id", "label_key", F.array_join("alias_keys", "|").alias("alias"), "excluded")


@query("original_sources", "SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND coalesce(page_id % 7 = 0, false) = false AND page_id % 5 <> 1")
def _original(t):
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "generated").when(F.col("page_id") % 3 == 1, "web").alias("source_type"),
                          F.when(F.col("page_id") % 7 == 0, True).alias("generated"), F.when(F.col("page_id") % 5 == 1, F.lit("file:///x")).otherwise(F.col("url")).alias("uri"))
    return graph.original_sources(rows).select("page_id")


LINK_SQL = """n AS (SELECT p_partkey AS id, CASE WHEN p_size <= 10 THEN 'MAIN' ELSE 'LOCAL' END AS origin FROM part),
e AS (SELECT DISTINCT l_partkey AS src, (l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM part) + 1 AS dst,
  CASE l_linenumber % 3 WHEN 0 THEN 'BROADER_THAN' WHEN 1 THEN 'RELATED_TO' ELSE 'ABOUT' END AS relation FROM lineitem)"""


@query("protected_links", f"""WITH {LINK_SQL} SELECT e.* FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst
WHERE relation <> 'ABOUT' AND b.origin <> 'LOCAL' AND (relation <> 'RELATED_TO' OR a.origin <> 'LOCAL')""")
def _protected(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 10, "MAIN").alias("origin"))
    parts = t.part.agg(F.count(F.lit(1))).scalar()
    relation = F.when(F.col("l_linenumber") % 3 == 0, "BROADER_THAN").when(F.col("l_linenumber") % 3 == 1, "RELATED_TO").otherwise("ABOUT")
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % parts + 1).alias("dst"), relation.alias("relation")).distinct()
    return graph.protected_edges(nodes, edges)


@query("comparable_runs", """WITH c AS (SELECT o_custkey AS run_id, o_orderstatus AS kind, min(o_orderpriority) AS h FROM orders GROUP BY ALL)
SELECT o_orderkey FROM orders JOIN c ON run_id = o_custkey AND kind = o_orderstatus WHERE (kind, h) IN (('F', '1-URGENT'), ('O', '2-HIGH'))""")
def _comparable(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("kind"), "o_orderpriority")
    configs = rows.groupBy("run_id", "kind").agg(F.min("o_orderpriority").alias("settings_hash"))
    current = t.orders.agg(F.explode(F.array(F.struct(F.lit("F").alias("kind"), F.lit("1-URGENT").alias("settings_hash")),
                                             F.struct(F.lit("O").alias("kind"), F.lit("2-HIGH").alias("settings_hash")))).alias("c")).select("c.*")
    return evaluation.comparable_rows(rows, configs, current).select("o_orderkey")


@query("work_estimate", """WITH d AS (SELECT DISTINCT md5(text) AS key, text FROM documents), c AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE doc_id % 3 = 0)
SELECT count(*) AS todo, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 4 * 0.25, 4) AS cost FROM d WHERE key NOT IN (SELECT key FROM c)""")
def _estimate(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("key"), "text")
    return evaluation.work_estimate(rows, rows.where("doc_id % 3 = 0").select("key").distinct(), 0.25).withColumn("cost", F.round("cost", 4))


@query("stale_embeddings", "SELECT vec_id FROM embeddings WHERE vec_id % 4 IN (1, 2)")
def _stale(t):
    wide = F.size("embedding")
    held = (F.when(F.col("vec_id") % 4 == 0, F.col("embedding")).when(F.col("vec_id") % 4 == 1, F.slice("embedding", 1, 8)).when(
        F.col("vec_id") % 4 == 2, F.concat("embedding", F.slice("embedding", 1, 1))).otherwise(F.slice("embedding", 1, 0)))
    dimensions = t.embeddings.select(wide.alias("n")).first()["n"]
    return graph.stale_embeddings(t.embeddings.select("vec_id", held.alias("embedding")), dimensions).select("vec_id")


@query("interrupted_runs", """SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < DATE '1996-01-01' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'completed' END AS status,
  CASE WHEN o_orderstatus = 'O' AND o_orderdate < DATE '1996-01-01' THEN 'Service restarted during query' END AS error FROM orders""")
def _interrupted(t):
    rows = t.orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"),
                           F.to_date("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("error"))
    return memory.fail_interrupted(rows, F.lit("1996-01-01").cast("date")).drop("created_at")


@query("fact_changes", """WITH l AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS kind, bool_or(event_id % 50 = 0) AS gone FROM events WHERE event_id % 5 = 0 GROUP BY user_id)
SELECT u.user_id AS id, coalesce(l.kind, 'fact') AS kind, CASE WHEN l.id IS NULL THEN 'old' ELSE 'new' END AS updated FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l ON l.id = user_id
WHERE l.gone IS NOT TRUE""")
def _changes(t):
    none = F.lit(None).cast("string")
    stored = t.events.select(F.lit("s").alias("scope"), F.col("user_id").alias("id")).distinct().withColumns(
        {"kind": F.lit("fact"), "text": F.lit("t"), "status": F.lit("active"), "updated_at": F.lit("old")})
    asked = t.events.where("event_id % 5 = 0").select(F.lit("s").alias("scope"), F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("kind"),
                                                      none.alias("text"), none.alias("status"), F.when(F.col("event_id") % 50 == 0, True).alias("deleted"))
    return memory.change_facts(stored, asked, F.lit("new")).select("id", "kind", F.col("updated_at").alias("updated"))


@query("fact_lines", "SELECT 'user:' || user_id % 3 AS scope, event_id AS id, event_type || ': ' || event_type AS line FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0")
def _lines(t):
    scope = F.when(F.col("user_id") % 3 == 0, F.lit("shared")).otherwise(F.concat(F.lit("user:"), (F.col("user_id") % 3).cast("string")))
    facts = t.events.select(scope.alias("scope"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("kind"), F.col("event_type").alias("text"),
                            F.when(F.col("event_id") % 2 == 0, "active").otherwise("rejected").alias("status"))
    return memory.user_context(facts).drop("created_at")


@query("useful_sources", """WITH f AS (SELECT page_id, url, page_id % 10 AS need, page_id AS place, (page_id % 4 + 1) / 7.0 AS s FROM pages WHERE page_id % 6 <> 0 AND page_id % 5 <> 0),
r AS (SELECT need, url, row_number() OVER (PARTITION BY need ORDER BY s DESC, place, url) AS rank FROM f) SELECT * FROM r WHERE rank <= 8""")
def _sources(t):
    found = t.pages.select((F.col("page_id") % 10).alias("need"), "url", ids.url_key(F.col("url")).alias("url_key"), F.col("page_id").alias("place"),
                           ((F.col("page_id") % 4 + 1) / 7.0).alias("host_score"), F.when(F.col("page_id") % 5 == 0, "blocked").alias("skip_reason"), "page_id")
    forgotten = found.where("page_id % 6 = 0").select("url_key")
    return memory.external_sources(found, forgotten, 8, "need").select("need", "url", "rank")


@query("used_searches", """SELECT o_orderkey AS key, bool_or(l_linenumber = 1 AND l_suppkey % 2 = 0) OR o_orderkey % 9 = 0 AS used FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def _used(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("documents"))
    searches = rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_orderkey").alias("key"), "documents", (F.col("l_orderkey") % 9 == 0).alias("used"))
    context = t.lineitem.where("l_linenumber = 1 AND l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("query_id"), F.array("l_suppkey").alias("documents"))
    return memory.mark_used(searches, context).select("key", "used")


@query("session_keys", """WITH s AS (SELECT conv_id, '2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') AS day, list([role, text] ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id AS session, sha1(day || to_json(turns)::VARCHAR) AS key FROM s""")
def _keys(t):
    day = F.make_date(F.lit(2024), F.lit(1), (F.col("conv_id") % 28 + 1).cast("int"))
    turns = t.conversations.select(F.col("conv_id").alias("session"), day.alias("day"), "turn", "role", F.col("text").alias("content"))
    return conversations.session_keys(turns).select("session", "key")


@query("packed_vectors", """WITH s AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s)
SELECT vec_id, 32 AS bytes, round(v[1] / n, 4) AS first, round(list_sum(v) / n, 4) AS total FROM n""")
def _packed(t):
    short = t.embeddings.select("vec_id", vectors.shorten(F.col("embedding"), 8).alias("v"))
    short = short.groupBy("vec_id").agg(F.first("v").alias("v"))  # Spark cannot hand nested lambdas to a Python function
    packed = short.select("vec_id", vectors.pack_vector(F.col("v").cast("array<float>")).alias("p"))
    back = packed.select("vec_id", F.length("p").alias("bytes"), vectors.unpack_vector(F.col("p")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", "bytes", F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"), F.round(total, 4).alias("total"))


@query("file_names", r"""SELECT doc_id, left(regexp_replace('f ' || source || '?' || lang || '.pdf', '[^\p{L}\p{N}_. -]', '_', 'g'), 200) AS name,
  left(sha1(source || '|' || text), 12) AS memory_id, left(sha256(doc_id::VARCHAR || chr(0) || lang), 16) AS digest FROM documents""")
def _names(t):
    name = F.concat(F.lit("a/b\\f "), "source", F.lit("?"), "lang", F.lit(".pdf"))
    return t.documents.select("doc_id", ids.safe_filename(name).alias("name"), ids.memory_id(F.col("source"), F.col("text")).alias("memory_id"), ids.digest(F.col("doc_id"), F.col("lang")).alias("digest"))


@query("token_cuts", r"""SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INTEGER AS tokens, md5(CASE WHEN len(regexp_extract_all(text, '\S+')) <= doc_id % 300 THEN text
  ELSE array_to_string(regexp_extract_all(text, '\s*\S+')[1:doc_id % 300], '') END) AS cut FROM documents""")
def _cuts(t):
    return t.documents.select("doc_id", text.token_count(F.col("text")).alias("tokens"), F.md5(text.truncate_tokens(F.col("text"), (F.col("doc_id") % 300).cast("int"))).alias("cut"))


@query("clean_answers", """WITH d AS (SELECT doc_id, trim(text, ' ') AS text FROM documents)
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN trim(text, ' ') WHEN 1 THEN trim(text, ' ') WHEN 2 THEN text ELSE 'I couldn''t find an answer.' END) AS answer FROM d""")
def _answers(t):
    body = F.trim("text")
    raw = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" <thinking>let me\nsee</thinking> <answer>"), body, F.lit("</answer>")))
           .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Thought: it is so. Answer: "), body)).when(F.col("doc_id") % 4 == 2, body).otherwise(F.lit("FAIL TO GENERATE ANS.")))
    return t.documents.select("doc_id", F.md5(answers.clean_answer(raw)).alias("answer"))


@query("length_rule", r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
SELECT doc_id, n > (doc_id % 400) * 1.1 AS over FROM d""")
def _length(t):
    answer = F.concat("text", F.lit(" [a]"))
    return t.documents.select("doc_id", answers.over_length(answer, F.array(F.lit("a")), F.col("doc_id") % 400).alias("over"))


@query("session_order", """WITH f AS (SELECT o_custkey AS query_id, o_orderpriority AS session, min(o_orderkey) AS first_rank FROM orders GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, session) AS rank FROM f""")
def _order(t):
    return fusion.first_appearance(t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("session"), F.col("o_orderkey").alias("rank")), "session")


@query("newest_orders", """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3""")
def _newest(t):
    return fusion.newest_first(t.orders, ["o_custkey"], F.col("o_orderdate"), 3, "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("seeded_sample", """SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) <= 20""")
def _sample(t):
    return fusion.hash_sample(t.documents.select("doc_id", "lang"), "doc_id", ["lang"], limit=20, seed=3)


@query("url_documents", """SELECT url, 'd:' || page_id % 50 AS document_id FROM pages WHERE page_id % 4 = 0""")
def _from_urls(t):
    sources = t.pages.select(F.concat(F.lit("s:"), F.col("page_id").cast("string")).alias("id"), F.lit("Source").alias("kind"), F.col("url").alias("uri"))
    edges = t.pages.select(F.concat(F.lit("s:"), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("d:"), (F.col("page_id") % 50).cast("string")).alias("dst"), F.lit("PROVIDES").alias("relation"))
    return graph.documents_from(sources, edges, t.pages.where("page_id % 4 = 0").select("url"))


@query("frequent_leaves", """SELECT user_id AS id FROM events GROUP BY user_id HAVING count(*) >= 3 AND user_id % 4 <> 0""")
def _frequent(t):
    used = memory.hits(t.events.select(F.col("user_id").alias("node_id"), (F.col("event_id") % 2 == 0).alias("success")))
    leaves = t.events.select(F.col("user_id").alias("id")).distinct()
    return inference.enrichment_candidates(used, leaves, leaves.where("id % 4 = 0"))


@query("concept_review", """SELECT o_custkey AS document_id, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'accepted') AS reason, count(*) AS n FROM orders GROUP BY ALL""")
def _review(t):
    rows = t.orders.select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("reason"), F.lit("accepted").alias("outcome"))
    return concepts.review(rows)
