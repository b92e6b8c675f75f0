"""Memory upkeep on events and conversations: sequences, gaps, working memory, counters, episodes, reuse, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import context, evaluation, memory
from ..sources import conversations
from .registry import query
from .search import STOP_SQL, WORDS_SQL


@query("event_sequence", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events""")
def _sequence(t):
    return memory.event_sequence(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select(
        "event_id", "user_id", F.col("sequence").cast("long").alias("sequence"))


GAP_SQL = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)"""


@query("session_gaps", f"WITH {GAP_SQL} SELECT user_id, run, count(*) AS events, min(event_id) AS first_event FROM runs GROUP BY ALL")
def _gaps(t):
    runs = memory.sessionize(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 10800)
    return runs.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))


@query("working_memory", f"""WITH {GAP_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, max(run) OVER (PARTITION BY user_id) AS last_run, count(*) OVER (PARTITION BY user_id) AS total FROM runs),
v AS (SELECT user_id, event_type AS cue, max(value * pow(0.5, total - n)) AS activation FROM n WHERE run = last_run GROUP BY ALL)
SELECT user_id, cue, round(activation, 6) AS activation FROM v""")
def _working(t):
    updates = t.events.select("user_id", "event_id", "ts", F.col("event_type").alias("cue"), F.col("value").alias("activation"))
    held = memory.working_memory(updates, ["user_id"], "ts", "event_id", 3, 0.5, 40)
    return held.select("user_id", "cue", F.round("activation", 6).alias("activation"))


@query("host_counters", """WITH c AS (SELECT 'host' AS kind, 'u' || user_id % 20 AS name, CASE event_type WHEN 'view' THEN 'found' WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'used' ELSE 'rejected' END AS counter FROM events),
s AS (SELECT kind, name, count(*) FILTER (counter = 'found') AS found, count(*) FILTER (counter = 'accepted') AS accepted, count(*) FILTER (counter = 'used') AS used, count(*) FILTER (counter = 'failed') AS failed FROM c GROUP BY ALL)
SELECT kind, name, found, accepted, used, failed, round((accepted + used + 1) / (found + 2), 6) AS score FROM s""")
def _counters(t):
    kind = F.col("event_type")
    counter = (F.when(kind == "view", F.lit("found")).when(kind == "click", F.lit("accepted")).when(kind == "error", F.lit("failed"))
               .when(kind == "purchase", F.lit("used")).otherwise(F.lit("rejected")))
    rows = t.events.select(F.lit("host").alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("name"), counter.alias("counter"), F.lit(1).alias("n"))
    return memory.counters(rows).select("kind", "name", "found", "accepted", "used", "failed", F.round(memory.usefulness(), 6).alias("score"))


@query("node_hits", """SELECT user_id AS node_id, count(*) FILTER (event_type <> 'purchase') AS navigation_hits, count(*) FILTER (event_type = 'purchase') AS successful_retrievals FROM events GROUP BY user_id""")
def _hits(t):
    return memory.hits(t.events.select(F.col("user_id").alias("node_id"), (F.col("event_type") == "purchase").alias("success")))


@query("host_gate", """WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages),
s AS (SELECT host, count(*) AS found, count(*) FILTER (quality = 1) AS accepted FROM p LEFT JOIN labels ON doc_id = page_id GROUP BY host)
SELECT page_id, host, CASE WHEN host LIKE 'blog.%' THEN 'host blocked: blog' WHEN found >= 3 AND accepted = 0 THEN 'host never useful (0 of ' || found || ' found sources accepted)' END AS skip_reason,
  round((accepted + 1) / (found + 2), 6) AS host_score FROM p JOIN s USING (host)""")
def _gate(t):
    pages = t.pages.select("page_id", "url", ids.host(F.col("url")).alias("host"))
    seen = pages.join(t.labels.select(F.col("doc_id").alias("page_id"), "quality"), "page_id", "left")
    events = seen.select(F.lit("host").alias("kind"), F.col("host").alias("name"), F.explode(F.array(
        F.struct(F.lit("found").alias("c"), F.lit(1).alias("n")), F.struct(F.lit("accepted").alias("c"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("n")))).alias("e")
    ).select("kind", "name", F.col("e.c").alias("counter"), F.col("e.n").alias("n"))
    blocks = pages.where(F.col("host").startswith("blog.")).select(F.col("host").alias("name"), F.lit("blog").alias("reason"), F.col("page_id").alias("at"))
    gated = memory.host_gate(pages, memory.counters(events), memory.current_blocks(blocks), 3)
    return gated.select("page_id", "host", "skip_reason", F.round("host_score", 6).alias("host_score"))


def _turns(t):
    return t.conversations.select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content"),
                                  F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).alias("day"))


ROUNDS_SQL = """f AS (SELECT conv_id, arg_min(role, turn) AS head FROM conversations GROUP BY conv_id),
r AS (SELECT c.*, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - (head = 'user')::INT AS round FROM conversations c JOIN f USING (conv_id))"""


@query("rounds", f"""WITH {ROUNDS_SQL} SELECT conv_id AS session, round, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM r GROUP BY ALL""")
def _rounds(t):
    rows = conversations.round_texts(conversations.with_rounds(_turns(t)))
    return rows.select("session", "round", "turns", F.md5("text").alias("digest"))


@query("transcripts", f"""WITH {ROUNDS_SQL}, l AS (SELECT conv_id, round, string_agg(upper(role) || ': ' || CASE WHEN len(text) <= lim THEN text ELSE left(text, lim) || ' [...]' END, chr(10) ORDER BY turn) AS lines
  FROM (SELECT *, CASE WHEN role = 'user' THEN 3000 ELSE 1000 END AS lim FROM r) GROUP BY ALL)
SELECT conv_id AS session, md5('Session date: ' || strftime(DATE '2024-01-01' + (conv_id % 365)::INT, '%Y-%m-%d (%a)') || chr(10) ||
  string_agg(chr(10) || '[round ' || round::INT || ']' || chr(10) || lines, chr(10) ORDER BY round)) AS digest FROM l GROUP BY conv_id""")
def _transcripts(t):
    return conversations.transcripts(conversations.with_rounds(_turns(t))).select("session", F.md5("transcript").alias("digest"))


BUDGET_SQL = """fold AS (SELECT q, list_reduce(list({used: 0::BIGINT, s: s::BIGINT, id: id, ids: []::BIGINT[]} ORDER BY place),
  lambda a, x: CASE WHEN a.used + x.s <= BUDGET THEN {used: a.used + x.s, s: 0::BIGINT, id: 0::BIGINT, ids: list_append(a.ids, x.id)} ELSE a END,
  {used: 0::BIGINT, s: 0::BIGINT, id: 0::BIGINT, ids: []::BIGINT[]}) AS a FROM items GROUP BY q)"""


@query("greedy_budget", f"""WITH items AS (SELECT source AS q, doc_id AS id, n_chars AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
{BUDGET_SQL.replace('BUDGET', '20000')} SELECT q AS query_id, unnest(a.ids) AS doc_id FROM fold""")
def _budget(t):
    items = t.documents.select(F.col("source").alias("query_id"), "doc_id", F.col("n_chars").alias("size"), F.col("doc_id").alias("rank"))
    return context.greedy_budget(items, 20000)


@query("round_history", f"""WITH {ROUNDS_SQL}, x AS (SELECT conv_id, round, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM r GROUP BY ALL),
items AS (SELECT conv_id % 10 AS q, (conv_id * 1000 + round)::BIGINT AS id, len(regexp_extract_all(text, '\\S+')) AS s, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY len(text) DESC, conv_id, round) AS place FROM x),
{BUDGET_SQL.replace('BUDGET', '600')}, c AS (SELECT q, unnest(a.ids) AS id FROM fold),
j AS (SELECT q, conv_id, round, text FROM c JOIN x ON c.id = conv_id * 1000 + round),
b AS (SELECT q, conv_id, string_agg(text, chr(10) ORDER BY round) AS content FROM j GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY conv_id) AS n FROM b)
SELECT q AS query_id, count(*) AS sessions, md5(string_agg('### Session ' || n || ':' || chr(10) || 'Session Date: ' || conv_id || chr(10) || 'Session Content:' || chr(10) || content, chr(10) ORDER BY n)) AS digest FROM n GROUP BY q""")
def _history(t):
    rounds = conversations.round_texts(conversations.with_rounds(_turns(t)))
    rows = rounds.select((F.col("session") % 10).alias("query_id"), "session", "round", "text", (F.col("session") * 1000 + F.col("round")).alias("doc_id"),
                         text.token_count(F.col("text")).alias("size"),
                         F.struct((-F.length("text")).alias("l"), "session", "round").alias("rank"))
    chosen = rows.join(context.greedy_budget(rows, 600), ["query_id", "doc_id"], "left_semi").withColumn("stamp", F.col("session"))
    return conversations.packed_history(chosen).select("query_id", "sessions", F.md5("history").alias("digest"))


EPISODE_SQL = f"""w AS (SELECT conv_id, turn, text, {WORDS_SQL.format('text')} AS w FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, text, array_to_string(list_sort(CASE WHEN len(list_filter(w, lambda x: x NOT IN ({STOP_SQL}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({STOP_SQL})) ELSE w END), ' ') AS terms FROM w),
k AS (SELECT *, 'user:' || conv_id % 7 AS scope, 'user:' || conv_id % 7 || '|' || left(sha256('answer|True|None|False|False|' || terms), 32) AS key FROM e)"""


@query("episodes", f"""WITH {EPISODE_SQL}
SELECT scope, key, count(*) AS count, min(conv_id * 100 + turn) AS first_at, max(conv_id * 100 + turn) AS asked_at, arg_max(md5(text), conv_id * 100 + turn) AS latest FROM k GROUP BY ALL""")
def _episodes(t):
    scope = F.concat(F.lit("user:"), (F.col("conv_id") % 7).cast("string"))
    options = ids.episode_options(F.lit("answer"), F.lit(True), F.lit(None), F.lit(False), F.lit(False))
    at = F.col("conv_id") * 100 + F.col("turn")
    asked = t.conversations.where("role = 'user'").select(
        scope.alias("scope"), ids.episode_key(scope, options, F.col("text")).alias("key"), at.alias("query_id"), at.alias("at"),
        F.col("text").alias("question"), F.md5("text").alias("answer"))
    return memory.episodes(asked).select("scope", "key", "count", "first_at", "asked_at", F.col("answer").alias("latest"))


@query("as_of_reuse", """WITH p AS (SELECT *, lag(event_id) OVER w AS pid, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, user_id, CASE WHEN ts - pts <= INTERVAL 24 HOUR THEN pid END AS reused_id FROM p""")
def _reuse(t):
    rows = memory.as_of_reuse(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 86400)
    return rows.select("event_id", "user_id", "reused_id")


@query("episode_reuse", """WITH q AS (SELECT event_id, user_id, ts, 'user:' || user_id % 9 AS scope FROM events WHERE event_type = 'click'),
e AS (SELECT event_id AS eid, user_id AS k, ts AS at, 'user:' || user_id % 9 AS scope, value > 5 AS done, floor(value)::INT % 4 AS size FROM events WHERE event_type = 'purchase'),
m AS (SELECT 'user:' || user_id % 9 AS scope, max(ts) - INTERVAL 9 DAY AS changed FROM events WHERE event_type = 'error' GROUP BY ALL),
c AS (SELECT q.event_id AS query_id, eid, row_number() OVER (PARTITION BY q.event_id ORDER BY e.at DESC, user_id) AS r FROM q JOIN e ON e.k = q.user_id AND e.scope = q.scope JOIN m ON m.scope = q.scope
  WHERE e.at < q.ts AND e.at >= q.ts - INTERVAL 24 HOUR AND done AND size > 0 AND e.at > changed)
SELECT query_id, eid AS episode_id FROM c WHERE r = 1""")
def _episode_reuse(t):
    scope = F.concat(F.lit("user:"), (F.col("user_id") % 9).cast("string")).alias("scope")
    kind = F.col("event_type")
    options = F.lit("o").alias("options")
    questions = t.events.where(kind == "click").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("key"), scope, options, F.col("ts").alias("at"))
    found = t.events.where(kind == "purchase").select(F.col("event_id").alias("episode_id"), F.col("user_id").alias("key"), scope, options, F.col("ts").alias("at"),
                                                      (F.col("value") > 5).alias("completed"), (F.floor("value") % 4).alias("context_size"))
    changes = t.events.where(kind == "error").select(scope, (F.col("ts") - F.make_dt_interval(F.lit(9))).alias("at"))
    return memory.reusable_episode(questions, found, changes).select("query_id", "episode_id")


@query("retention", """WITH q AS (SELECT user_id AS query_id, max(ts) AS created_at, CASE WHEN user_id % 10 = 0 THEN 'running' ELSE 'completed' END AS status FROM events WHERE event_type = 'view' GROUP BY user_id),
kept AS (SELECT query_id FROM q WHERE status = 'running' OR created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY)
SELECT event_id, user_id AS query_id FROM events WHERE user_id IN (SELECT query_id FROM kept)""")
def _retention(t):
    events = t.events.select("event_id", F.col("user_id").alias("query_id"), F.col("ts").alias("at"), "event_type")
    queries = events.where("event_type = 'view'").groupBy("query_id").agg(F.max("at").alias("created_at")).withColumn(
        "status", F.when(F.col("query_id") % 10 == 0, F.lit("running")).otherwise(F.lit("completed")))
    kept = memory.retention(queries, events, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 1)[1]
    return kept.select("event_id", "query_id")


@query("user_facts", """WITH p AS (SELECT 'user:' || conv_id % 50 AS scope, conv_id * 100 + turn AS id, text, role FROM conversations),
known AS (SELECT * FROM p WHERE role = 'system'), rest AS (SELECT * FROM p WHERE role <> 'system'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY scope, lower(replace(text, 'ß', 'ss')) ORDER BY id) AS n FROM rest r WHERE NOT EXISTS (
  SELECT 1 FROM known k WHERE k.scope = r.scope AND lower(replace(k.text, 'ß', 'ss')) = lower(replace(r.text, 'ß', 'ss'))))
SELECT scope, id, md5(text) AS digest FROM known UNION ALL SELECT scope, id, md5(text) FROM fresh WHERE n = 1""")
def _facts(t):
    at = F.col("conv_id") * 100 + F.col("turn")
    rows = t.conversations.select(F.concat(F.lit("user:"), (F.col("conv_id") % 50).cast("string")).alias("scope"), at.alias("id"), F.lit("profile").alias("kind"), "text",
                                  F.lit("stated").alias("origin"), F.lit("active").alias("status"), F.array(F.lit("q")).alias("evidence"), at.alias("created_at"), "role")
    merged = memory.add_facts(rows.where("role = 'system'").drop("role"), rows.where("role <> 'system'").drop("role"))
    return merged.select("scope", "id", F.md5("text").alias("digest"))


@query("usage_metrics", """SELECT count(*) AS calls, sum(user_id)::BIGINT AS input_tokens, sum(event_id)::BIGINT AS output_tokens, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END), 4) AS reported_cost,
  count(*) FILTER (event_type = 'error') AS calls_without_cost, count(*) FILTER (event_type = 'view') AS needs, sum(user_id % 3) FILTER (event_type = 'view')::BIGINT AS skipped_as_recent,
  count(*) FILTER (event_type = 'view' AND value > 10) AS reached_context FROM events""")
def _usage(t):
    usage = t.events.select(F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"), F.when(F.col("event_type") != "error", F.col("value")).alias("estimated_cost"))
    searches = t.events.where("event_type = 'view'").select((F.col("user_id") % 3).alias("reused"), (F.col("value") > 10).alias("used"))
    return memory.usage_metrics(usage, searches).withColumn("reported_cost", F.round("reported_cost", 4))


@query("mcnemar", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS a, count(*) FILTER (toxic = 1 AND quality = 0) AS b FROM labels)
SELECT a AS only_a, b AS only_b, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a, b) + 1),
  lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))))) END, 6) AS p_value FROM c""")
def _mcnemar(t):
    pairs = t.labels.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return evaluation.mcnemar(pairs, "a", "b").withColumn("p_value", F.round("p_value", 6))


@query("calibration", """WITH l AS (SELECT quality AS ok, (doc_id * 37 % 100) / 100.0 AS confidence FROM labels), s AS (SELECT unnest(generate_series(50, 95, 5)) AS percent)
SELECT percent / 100 AS threshold, count(*) AS accepted, round(avg(ok), 6) AS precision FROM s JOIN l ON confidence >= percent / 100.0 GROUP BY percent""")
def _calibration(t):
    rows = t.labels.select((F.col("quality") == 1).alias("ok"), ((F.col("doc_id") * 37 % 100) / 100).alias("confidence"))
    return evaluation.calibration(rows).withColumn("precision", F.round("precision", 6))


@query("coverage_rollup", """WITH needs AS (SELECT doc_id, source AS query_id, 'need' || doc_id AS need_id, lang AS description FROM documents),
v AS (SELECT 'need' || l.doc_id AS need_id, CASE WHEN quality = 1 THEN 'COVERED' WHEN toxic = 1 THEN 'PARTIAL' ELSE 'MISSING' END AS status, l.doc_id FROM labels l),
ctx AS (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0)
SELECT n.query_id, n.need_id, CASE WHEN c.source IS NULL OR v.status IS NULL OR n.doc_id % 3 <> 0 THEN 'MISSING' ELSE v.status END AS status,
  CASE WHEN c.source IS NULL THEN n.description WHEN v.status IS NULL THEN 'Coverage was not assessed' WHEN v.status <> 'MISSING' AND n.doc_id % 3 <> 0 THEN 'No supporting evidence was cited' ELSE '' END AS missing
FROM needs n LEFT JOIN v USING (need_id) LEFT JOIN ctx c ON c.source = n.query_id""")
def _coverage(t):
    name = F.concat(F.lit("need"), F.col("doc_id").cast("string"))
    evidence = F.concat(F.lit("e"), F.col("doc_id").cast("string"))
    needs = t.documents.select(F.col("source").alias("query_id"), name.alias("need_id"), F.col("lang").alias("description"))
    status = F.when(F.col("quality") == 1, F.lit("COVERED")).when(F.col("toxic") == 1, F.lit("PARTIAL")).otherwise(F.lit("MISSING"))
    given = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("query_id"), name.alias("need_id"), F.col("doc_id").alias("at"), status.alias("status"), F.array(evidence, F.lit("e-1")).alias("evidence_ids"), F.lit("").alias("missing"))
    held = t.documents.where("doc_id % 3 = 0").select(F.col("source").alias("query_id"), evidence.alias("evidence_id"))
    return context.coverage_rollup(needs, given, held).select("query_id", "need_id", "status", "missing")
