"""Text jobs over documents and pages: normal forms, figures, quality, time cues, keys, passages, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, ids, text
from ..operators import skew
from ..sources import passages
from .registry import query, sql_list
from .search import STOP_SQL, WORDS_SQL

NORM_SQL = """list_transform(regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}_]+'),
  lambda w: CASE WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, len(w) - 1) ELSE w END)"""


@query("text_norm", f"""WITH n AS (SELECT doc_id, {NORM_SQL.format('text')} AS w FROM documents)
SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM n""")
def _norm(t):
    rows = t.documents.select("doc_id", text.norm_words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("facts_by_number", """SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?'),
  lambda n: replace(n, ',', '.')))), '|') AS figures FROM documents WHERE regexp_matches(text, '\\d')""")
def _numbers(t):
    rows = t.documents.select("doc_id", text.numbers(F.col("text")).alias("n")).where(F.size("n") > 0)
    return rows.select("doc_id", F.array_join("n", "|").alias("figures"))


@query("corrupted_text", f"""WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda w:
  CASE WHEN w IN ({sql_list(text.ENGLISH_WORDS)}) THEN 1 WHEN w IN ({sql_list([w for w in text.FRENCH_WORDS])}) THEN -1 ELSE 0 END) AS v,
  lead(text) OVER (ORDER BY doc_id) AS session FROM documents),
e AS (SELECT *, coalesce(list_sum(v), 0) AS lean, lead(coalesce(list_sum(v), 0)) OVER (ORDER BY doc_id) AS session_lean FROM d)
SELECT doc_id, lean, (regexp_matches(text, '\\(\\)|\\]\\]|~~|\\[s\\d+\\]|\\[date\\]|">|[a-z][A-Z][a-z]+\\(|(\\.\\.\\.|…)\\s*$')
  OR (lean > 1 AND coalesce(session_lean, 0) < -5)) AS corrupted FROM e""")
def _corrupted(t):
    docs = t.documents.select("doc_id", "text")
    # The next document stands for the session a memory was written about.
    session = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("session"))
    return docs.join(session, "doc_id", "left").select(
        "doc_id", text.english_lean(F.col("text")).cast("long").alias("lean"), text.corrupted(F.col("text"), F.coalesce("session", F.lit(""))).alias("corrupted"))


CUE_SQL = """SELECT event_id, ts::DATE AS now, CASE event_id % 9 WHEN 0 THEN (event_id % 11 + 1) || ' weeks ago we met' WHEN 1 THEN 'in the past ' || (event_id % 5 + 2) || ' months'
  WHEN 2 THEN 'Last Year was fine' WHEN 3 THEN 'what about this month' WHEN 4 THEN 'yesterday at noon' WHEN 5 THEN 'only today' WHEN 6 THEN 'since March'
  WHEN 7 THEN 'in February, ' || (2000 + event_id % 24) ELSE 'a couple of days ago' END AS cue FROM events"""


@query("time_window", f"""WITH c AS ({CUE_SQL}), w AS (SELECT event_id, cue, CASE event_id % 9
  WHEN 0 THEN now - ((event_id % 11 + 1) * 7 + (event_id % 11 + 1))::INT WHEN 1 THEN now - ((event_id % 5 + 2) * 30)::INT WHEN 2 THEN now - 365 WHEN 3 THEN now - 30 WHEN 4 THEN now - 1
  WHEN 5 THEN now WHEN 6 THEN make_date(year(now) - (month(now) < 3)::INT, 3, 1) WHEN 7 THEN make_date(2000 + event_id % 24, 2, 1) ELSE now - 3 END AS start_day, CASE event_id % 9
  WHEN 0 THEN now - ((event_id % 11 + 1) * 7 - (event_id % 11 + 1))::INT WHEN 1 THEN now WHEN 2 THEN now WHEN 3 THEN now WHEN 4 THEN now - 1 WHEN 5 THEN now
  WHEN 6 THEN make_date(year(now) - (month(now) < 3)::INT, 3, 31) WHEN 7 THEN last_day(make_date(2000 + event_id % 24, 2, 1)) ELSE now - 1 END AS end_day FROM c)
SELECT event_id, cue, start_day::VARCHAR AS start_day, end_day::VARCHAR AS end_day FROM w""")
def _time(t):
    e = F.col("event_id")
    kind = e % 9
    cue = (F.when(kind == 0, F.concat((e % 11 + 1).cast("string"), F.lit(" weeks ago we met")))
           .when(kind == 1, F.concat(F.lit("in the past "), (e % 5 + 2).cast("string"), F.lit(" months")))
           .when(kind == 2, F.lit("Last Year was fine")).when(kind == 3, F.lit("what about this month")).when(kind == 4, F.lit("yesterday at noon"))
           .when(kind == 5, F.lit("only today")).when(kind == 6, F.lit("since March"))
           .when(kind == 7, F.concat(F.lit("in February, "), (2000 + e % 24).cast("string"))).otherwise(F.lit("a couple of days ago")))
    rows = t.events.select("event_id", F.to_date("ts").alias("now"), cue.alias("cue"))
    found = rows.select("event_id", "cue", text.time_window(F.col("cue"), F.col("now")).alias("w"))
    return found.select("event_id", "cue", F.col("w.start").cast("string").alias("start_day"), F.col("w.end").cast("string").alias("end_day"))


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


@query("page_hosts", f"""SELECT host, count(*) AS pages, count(*) FILTER (regexp_matches(url, '^https://[^@:/?#]+(:443)?([/?#]|$)')) AS safe, min(sha256(url)) AS first_key
FROM (SELECT url, {HOST_SQL} AS host FROM pages) GROUP BY host""")
def _hosts(t):
    rows = t.pages.select("url", ids.host(F.col("url")).alias("host"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(ids.safe_url(F.col("url"))).alias("safe"), F.min(ids.url_key(F.col("url"))).alias("first_key"))


@query("passages_100w", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 100)) AS pos FROM w)
SELECT doc_id, pos // 100 AS passage, md5(array_to_string(w[pos + 1:pos + 100], ' ')) AS digest FROM s""")
def _passages(t):
    cut = passages.word_passages(t.documents.select("doc_id", "text"))
    return cut.select("doc_id", "passage", F.md5("text").alias("digest"))


@query("doc_dedupe", """WITH h AS (SELECT doc_id, source, sha256(text) AS digest FROM documents),
f AS (SELECT digest, min(doc_id) AS document, count(*) AS copies, count(DISTINCT source) AS sources FROM h GROUP BY digest)
SELECT doc_id, document, doc_id <> document AS duplicate, copies, sources FROM h JOIN f USING (digest)""")
def _dedupe(t):
    return passages.registered_copies(t.documents.select("doc_id", "source", F.sha2("text", 256).alias("digest")))


@query("citations", """WITH known AS (SELECT ['a', 'b', 'c'] AS k), d AS (SELECT doc_id, 'It holds [a] that ' || replace(text, '[', '(') || ' [b, c] and [a]' ||
  CASE WHEN doc_id % 2 = 0 THEN ' also [zz, a].' ELSE ' [c].' END AS answer FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a|b|c' ELSE 'a|b|c' END AS cited,
  md5(replace(replace(replace(replace(answer, '[b, c]', '[id2][id3]'), '[a]', '[id1]'), ' [c].', ' [id3].'), 'zzz', 'zzz')) AS rewritten,
  md5(regexp_replace(answer, '\\s*\\[(a|b, c|c)\\]', '', 'g')) AS bare FROM d""")
def _citations(t):
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit(" also [zz, a].")).otherwise(F.lit(" [c]."))
    rows = t.documents.select("doc_id", F.concat(F.lit("It holds [a] that "), F.replace(F.col("text"), F.lit("["), F.lit("(")),
                                                 F.lit(" [b, c] and [a]"), tail).alias("answer"))
    known = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    real = F.create_map(F.lit("a"), F.lit("id1"), F.lit("b"), F.lit("id2"), F.lit("c"), F.lit("id3"))
    answer = F.col("answer")
    return rows.select("doc_id", F.array_join(answers.cited(answer, known), "|").alias("cited"), F.md5(answers.real_citations(answer, real)).alias("rewritten"),
                       F.md5(answers.without_citations(answer, known)).alias("bare"))


@query("named_entities", f"""WITH names AS (SELECT DISTINCT array_to_string({NORM_SQL.format('p_name')}, ' ') AS name FROM part),
d AS (SELECT doc_id, {NORM_SQL.format("text || ' ' || 'small ring ' || lang")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS name FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT unnest(generate_series(1, 6)) AS n)))
SELECT doc_id, name FROM g JOIN names USING (name)""")
def _named(t):
    from ..operators import spreading
    names = t.part.select(text.norm(F.col("p_name")).alias("name")).distinct().withColumn("node", F.col("name"))
    rows = t.documents.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "text", F.lit("small ring"), "lang").alias("text"))
    return spreading.named_entities(rows, names).select(F.col("query_id").alias("doc_id"), F.col("node").alias("name"))


@query("stratified_split", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE place <= floor(n * 0.2 + 0.5)""")
def _split(t):
    from ..operators import fusion
    return fusion.hash_sample(t.documents.select("doc_id", "lang"), "doc_id", ["lang"], share=0.2, seed=7)


@query("search_keys", f"""WITH w AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
k AS (SELECT item_id, w, list_filter(w, lambda x: x NOT IN ({STOP_SQL})) AS kept FROM w)
SELECT item_id, 'shared|' || left(array_to_string(list_sort(CASE WHEN len(kept) > 0 THEN kept ELSE w END), ' '), 500) AS key FROM k""")
def _search_keys(t):
    return t.benchmark.select("item_id", ids.search_key(F.col("text"), F.lit("shared")).alias("key"))


@query("word_salting", """SELECT d.lang, count(*) AS pairs, sum(l.quality) AS good FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang""")
def _salted(t):
    # A language holds most documents: the join on it is salted, the result stays whole.
    totals = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    langs = t.documents.select("lang").distinct()
    return (skew.salted_join(totals, langs, ["lang"], hot_rows=100)
            .groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"), F.sum("quality").alias("good")))
