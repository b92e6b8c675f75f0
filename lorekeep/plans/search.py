"""Hybrid search over many queries: BM25 and vector rankings, fused, with metrics against verbatim gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import BM25_STOP_WORDS, STOP_WORDS, words
from ..functions.vectors import hash_embedding
from ..operators import evaluation, fusion, lexical, nearest
from ..session import cut_lineage
from .registry import query, sql_list


def hybrid_search(docs: DataFrame, queries: DataFrame, k: int = 5, pool: int = 10) -> DataFrame:
    """Fused top-k per query. docs: doc_id, text, vec; queries: query_id, text, vec."""
    sparse = lexical.bm25_topk(docs, queries, pool)
    dense = nearest.vector_topk(docs.select("doc_id", "vec"), queries.select("query_id", "vec"), pool)
    return fusion.reciprocal_rank_fusion([sparse, dense], limit=k)


def embedded(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("vec", hash_embedding(F.col(text)))


def _queries(t) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _docs(t) -> DataFrame:
    return t.documents.select("doc_id", "text")


# --- SQL building blocks ---
BM25_SQL = f"""
qt AS (SELECT DISTINCT item_id AS query_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)
    WHERE term NOT IN ({sql_list(BM25_STOP_WORDS)})),
dt AS (SELECT doc_id, term FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    WHERE term NOT IN ({sql_list(BM25_STOP_WORDS)})),
len AS (SELECT d.doc_id, count(dt.term) AS length FROM documents d LEFT JOIN dt USING (doc_id) GROUP BY d.doc_id),
stats AS (SELECT count(*) AS n, sum(length) / count(*) AS average FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
          / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), stats GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""


def hash_vectors(name, table, key):
    return f"""
{name}_b AS (SELECT {key} AS id, cast('0x' || substr(sha256(w), 3, 2) AS INT) % 64 AS b, count(*) AS c FROM (
    SELECT {key}, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM {table}) GROUP BY ALL),
{name}_l AS (SELECT id, sqrt(sum(c * c)) AS l FROM {name}_b GROUP BY ALL),
{name} AS (SELECT id, b, c / l AS v FROM {name}_b JOIN {name}_l USING (id))"""


DENSE_SQL = hash_vectors("qv", "benchmark", "item_id") + "," + hash_vectors("dv", "documents", "doc_id") + """,
cosines AS (SELECT qv.id AS query_id, dv.id AS doc_id, round(sum(qv.v * dv.v), 9) AS score FROM qv JOIN dv USING (b) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cosines)"""

GOLD_SQL = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
FUSED_SQL = """
fused AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM (
    SELECT query_id, doc_id, rank FROM sparse WHERE rank <= 10 UNION ALL
    SELECT query_id, doc_id, rank FROM dense WHERE rank <= 10) GROUP BY ALL),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused)"""


@query("hybrid_search", f"""WITH {BM25_SQL}, {DENSE_SQL}, {GOLD_SQL}, {FUSED_SQL}
SELECT h.query_id, h.doc_id, h.rank, round(h.score, 6) AS score, (g.doc_id IS NOT NULL)::INT AS is_gold
FROM hybrid h LEFT JOIN gold g ON g.query_id = h.query_id AND g.doc_id = h.doc_id WHERE rank <= 5""")
def _hybrid(t):
    queries, docs = _queries(t), _docs(t)
    found = hybrid_search(embedded(docs), embedded(queries))
    gold = lexical.containing(docs, queries, passage_col="query_id").withColumn("is_gold", F.lit(1))
    return found.join(gold, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", "rank", F.round("score", 6).alias("score"), F.coalesce("is_gold", F.lit(0)).alias("is_gold"))


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 10")
def _bm25(t):
    return lexical.bm25_topk(_docs(t), _queries(t), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("hard_negatives", f"""WITH {BM25_SQL}, {GOLD_SQL},
left_over AS (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, cast(doc_id AS VARCHAR) DESC) AS rank
  FROM bm ANTI JOIN gold USING (query_id, doc_id))
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM left_over WHERE rank <= 4""")
def _negatives(t):
    queries, docs = _queries(t), _docs(t)
    gold = lexical.containing(docs, queries, passage_col="query_id")
    return lexical.hard_negatives(docs, queries, gold, 4).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("verbatim_gold", f"WITH {GOLD_SQL} SELECT query_id, doc_id FROM gold")
def _gold(t):
    return lexical.containing(_docs(t), _queries(t), passage_col="query_id")


@query("dense_topk", """WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def _dense(t):
    rows = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return nearest.vector_topk(rows, asked, 5, exclude_same=True).select(
        "query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("similar_records", """WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS key, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM pairs WHERE score >= 0.25)
SELECT query_id, key, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10""")
def _records(t):
    scope = F.col("label").cast("string").alias("scope")
    rows = t.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), scope)
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), scope)
    return nearest.similar_records(rows, asked, 10, 0.25).select("query_id", "key", "rank", F.round("score", 6).alias("score"))


@query("rrf_fusion", f"""WITH {BM25_SQL}, {DENSE_SQL}, {FUSED_SQL}
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM hybrid""")
def _rrf(t):
    queries, docs = embedded(_queries(t)), embedded(_docs(t))
    sparse = lexical.bm25_topk(docs, queries, 10)
    dense = nearest.vector_topk(docs.select("doc_id", "vec"), queries.select("query_id", "vec"), 10)
    return fusion.reciprocal_rank_fusion([sparse, dense]).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("interleave", f"""WITH {BM25_SQL}, {DENSE_SQL},
places AS (SELECT query_id, doc_id, min(place) AS place FROM (
    SELECT query_id, doc_id, rank * 2 AS place FROM dense WHERE rank <= 12 UNION ALL
    SELECT query_id, doc_id, rank * 2 + 1 FROM sparse WHERE rank <= 12) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM places)
SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 12""")
def _interleave(t):
    queries, docs = embedded(_queries(t)), embedded(_docs(t))
    sparse = lexical.bm25_topk(docs, queries, 12)
    dense = nearest.vector_topk(docs.select("doc_id", "vec"), queries.select("query_id", "vec"), 12)
    return fusion.interleave([dense, sparse], 12)


def node_inputs(t) -> DataFrame:
    """Documents as retrieval nodes: language as label, hits from the events of the user with the document's number."""
    hits = (t.events.where(F.col("event_type") == "purchase").groupBy(F.col("user_id").alias("doc_id"))
            .agg(F.count(F.lit(1)).alias("hits")))
    docs = t.documents.select("doc_id", "text", F.concat_ws(" ", "lang", "source").alias("label")).join(hits, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("node_id"), words(F.col("label")).alias("label_words"), words(F.col("text")).alias("content_words"),
                       hash_embedding(F.col("text")).alias("vec"), F.coalesce("hits", F.lit(0)).alias("hits"))


STOP_SQL = sql_list(STOP_WORDS)
WORDS_SQL = "list_distinct(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'))"


@query("hybrid_rank", f"""WITH {DENSE_SQL},
hits AS (SELECT user_id AS doc_id, count(*) AS hits FROM events WHERE event_type = 'purchase' GROUP BY ALL),
q0 AS (SELECT item_id AS query_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
q1 AS (SELECT query_id, w, list_filter(w, lambda x: x NOT IN ({STOP_SQL})) AS kept FROM q0),
q AS (SELECT query_id, CASE WHEN len(kept) > 0 THEN kept ELSE w END AS terms FROM q1),
qterm AS (SELECT query_id, unnest(terms) AS term FROM q),
dterm AS (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS term, 0 AS label FROM documents
          UNION ALL SELECT doc_id, unnest({WORDS_SQL.format("lang || ' ' || source")}), 1 FROM documents),
lex AS (SELECT query_id, doc_id, count(DISTINCT term) AS found, count(DISTINCT CASE WHEN label = 1 THEN term END) AS labelled
        FROM qterm JOIN dterm USING (term) GROUP BY ALL),
scored AS (SELECT q.query_id, d.doc_id, round(0.5 * coalesce(found, 0) / greatest(len(terms), 1) + 0.35 * greatest(coalesce(score, 0), 0)
    + 0.1 * coalesce(labelled, 0) / greatest(len(terms), 1) + 0.0025 * least(coalesce(hits, 0), 20), 6) AS score
  FROM q CROSS JOIN documents d LEFT JOIN lex ON lex.query_id = q.query_id AND lex.doc_id = d.doc_id
  LEFT JOIN cosines c ON c.query_id = q.query_id AND c.doc_id = d.doc_id LEFT JOIN hits h ON h.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, doc_id AS node_id, rank, score FROM ranked WHERE rank <= 20""")
def _hybrid_rank(t):
    queries = embedded(_queries(t))
    ranked = nearest.hybrid_topk(node_inputs(t), queries, 20)
    return ranked.select("query_id", "node_id", "rank", F.round("score", 6).alias("score"))


@query("terms_top", f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents),
k AS (SELECT doc_id, w, list_filter(w, lambda x: x NOT IN ({STOP_SQL})) AS kept FROM w),
t AS (SELECT unnest(CASE WHEN len(kept) > 0 THEN kept ELSE w END) AS term FROM k)
SELECT term, count(*) AS df FROM t GROUP BY term""")
def _terms(t):
    return lexical.document_frequency(_docs(t))


@query("best_per_need", f"""WITH {BM25_SQL}, {DENSE_SQL},
both_lists AS (SELECT query_id, doc_id, max(score) AS score FROM (
  SELECT query_id, doc_id, score FROM sparse WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, score FROM dense WHERE rank <= 20) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM both_lists)
SELECT query_id AS need_id, doc_id AS node_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 20""")
def _best(t):
    queries, docs = embedded(_queries(t)), embedded(_docs(t))
    names = [F.col("query_id").alias("need_id"), F.col("doc_id").alias("node_id"), "score"]
    sparse = lexical.bm25_topk(docs, queries, 20).select(*names)
    dense = nearest.vector_topk(docs.select("doc_id", "vec"), queries.select("query_id", "vec"), 20).select(*names)
    return fusion.best_per_need([sparse, dense], 20).select("need_id", "node_id", "rank", F.round("score", 6).alias("score"))


METRICS_SQL = f"""WITH {BM25_SQL}, {DENSE_SQL}, {GOLD_SQL}, {FUSED_SQL},
arms AS (SELECT 'bm25' AS arm, query_id, doc_id, rank FROM sparse WHERE rank <= 10 UNION ALL
  SELECT 'dense', query_id, doc_id, rank FROM dense WHERE rank <= 10 UNION ALL
  SELECT 'hybrid', query_id, doc_id, rank FROM hybrid WHERE rank <= 10),
sizes AS (SELECT query_id, count(*) AS gold FROM gold GROUP BY ALL),
asked AS (SELECT * FROM sizes, (SELECT DISTINCT arm FROM arms)),
hits AS (SELECT arm, query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10,
   sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM arms JOIN gold USING (query_id, doc_id) GROUP BY ALL),
m AS (SELECT a.arm, a.query_id, (coalesce(h5, 0) > 0)::DOUBLE AS any5, (coalesce(h5, 0) >= gold)::DOUBLE AS all5, (coalesce(h10, 0) > 0)::DOUBLE AS any10,
   (coalesce(h10, 0) >= gold)::DOUBLE AS all10, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold, 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg10
   FROM asked a LEFT JOIN hits h ON h.arm = a.arm AND h.query_id = a.query_id)"""


def rankings(t):
    queries, docs = embedded(_queries(t)), embedded(_docs(t))
    # Each list is an arm and a part of the fused one; written once, it is not made again.
    sparse = cut_lineage(lexical.bm25_topk(docs, queries, 10))
    dense = cut_lineage(nearest.vector_topk(docs.select("doc_id", "vec"), queries.select("query_id", "vec"), 10))
    fused = fusion.reciprocal_rank_fusion([sparse, dense], limit=10)
    named = [x.select(F.lit(arm).alias("arm"), "query_id", "doc_id", "rank")
             for arm, x in (("bm25", sparse), ("dense", dense), ("hybrid", fused))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("retrieval_metrics", METRICS_SQL + """ SELECT arm, count(*) AS n, round(avg(any5), 6) AS any_at_5, round(avg(all5), 6) AS all_at_5,
  round(avg(any10), 6) AS any_at_10, round(avg(all10), 6) AS all_at_10, round(avg(ndcg10), 6) AS ndcg_at_10 FROM m GROUP BY arm""")
def _metrics(t):
    gold = cut_lineage(lexical.containing(_docs(t), _queries(t), passage_col="query_id"))
    scores = evaluation.retrieval_scores(rankings(t), gold)
    names = ["any_at_5", "all_at_5", "any_at_10", "all_at_10", "ndcg_at_10"]
    return evaluation.mean_report(scores, names).select("arm", "n", *[F.round(c, 6).alias(c) for c in names])
