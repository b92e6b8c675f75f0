"""Checks of search reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reuse
from .registry import query

DAY = 86400


@query("search_reuse", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, 1700000000 + (vec_id * 7919) % 90 * 86400 + vec_id AS ts FROM embeddings),
r AS (SELECT 2 * vec_id AS id, 's' || label % 3 AS scope, ts, 'key ' || vec_id % 97 AS key, e FROM v
  UNION ALL SELECT 2 * vec_id + 1, 's' || label % 3, ts + vec_id % 45 * 86400 + 60, NULL, list_concat([e[1] * 1.5 + 0.01], e[2:]) FROM v),
p AS (SELECT a.id, b.id AS other, b.ts, CASE WHEN a.key = b.key THEN 1.0 ELSE list_cosine_similarity(a.e, b.e) END AS s FROM r a JOIN r b
  ON a.scope = b.scope AND b.ts <= a.ts AND a.ts - b.ts <= 30 * 86400 AND (b.ts < a.ts OR b.id < a.id)),
m AS (SELECT id, arg_max(other, (ts, other)) AS reused_id, arg_max(s, (ts, other)) AS s FROM p WHERE s >= 0.94 GROUP BY id),
c AS (SELECT reused_id AS id, count(*) AS n FROM m GROUP BY ALL)
SELECT r.id, m.reused_id, round(m.s, 6) AS similarity, coalesce(c.n, 0) AS reused FROM r LEFT JOIN m ON m.id = r.id LEFT JOIN c ON c.id = r.id""")
def _search_reuse(t):
    """Every vector is asked twice: once as it is, with one of 97 keys, and up to 44 days later as a paraphrase without a key."""
    rows = t.embeddings.select("vec_id", F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("scope"), F.col("embedding").cast("array<double>").alias("vec"),
                               (1700000000 + (F.col("vec_id") * 7919) % 90 * DAY + F.col("vec_id")).alias("at"))
    first = rows.select((2 * F.col("vec_id")).alias("id"), "scope", "at", F.concat(F.lit("key "), (F.col("vec_id") % 97).cast("string")).alias("key"), "vec")
    bent = F.concat(F.array(F.col("vec")[0] * 1.5 + 0.01), F.slice("vec", 2, F.size("vec")))
    again = rows.select((2 * F.col("vec_id") + 1).alias("id"), "scope", (F.col("at") + F.col("vec_id") % 45 * DAY + 60).alias("at"), F.lit(None).cast("string").alias("key"), bent.alias("vec"))
    found = reuse.similar_reuse(first.union(again))
    counted = found.join(reuse.reuse_counts(found), "id", "left")
    return counted.select("id", "reused_id", F.round("similarity", 6).alias("similarity"), F.coalesce("reused", F.lit(0)).alias("reused"))
