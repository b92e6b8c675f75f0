"""Fusing ranked lists: reciprocal rank fusion, interleaving, best score per need, relative cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import top_per_group


def reciprocal_rank_fusion(lists: list[DataFrame], query_col: str = "query_id", id_col: str = "doc_id", k: int = 60,
                           limit: int | None = None) -> DataFrame:
    """Σ 1/(k + rank), ranks from 1, over the lists an item occurs in. Each list carries a `rank` column."""
    rows = reduce(DataFrame.unionByName, [x.select(query_col, id_col, "rank") for x in lists])
    fused = rows.groupBy(query_col, id_col).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    order = [F.round("score", 9).desc(), F.col(id_col)]
    if limit is not None:
        return top_per_group(fused, [query_col], order, limit)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy(*order)))


def interleave(lists: list[DataFrame], limit: int, query_col: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Round-robin merge without duplicates: first by rank, then by list."""
    rows = reduce(DataFrame.unionByName, [
        x.select(query_col, id_col, (F.col("rank") * len(lists) + i).alias("place")) for i, x in enumerate(lists)])
    first = rows.groupBy(query_col, id_col).agg(F.min("place").alias("place"))
    return top_per_group(first, [query_col], [F.col("place"), F.col(id_col)], limit).drop("place")


def best_per_need(lists: list[DataFrame], limit: int, need_col: str = "need_id", id_col: str = "node_id") -> DataFrame:
    """Candidates found for the need and for the original question: best score per node, then the limit."""
    rows = reduce(DataFrame.unionByName, [x.select(need_col, id_col, "score") for x in lists])
    best = rows.groupBy(need_col, id_col).agg(F.max("score").alias("score"))
    return top_per_group(best, [need_col], [F.round("score", 9).desc(), F.col(id_col)], limit)


def relative_cut(rows: DataFrame, group: list[str], share: float, score: str = "score") -> DataFrame:
    """Rows scoring at least `share` of their group's best. The best is a partial aggregate, not a window."""
    best = rows.groupBy(*group).agg(F.max(score).alias("__best"))
    return rows.join(best, group).where(F.col(score) >= F.lit(share) * F.col("__best")).drop("__best")


def first_appearance(ranking: DataFrame, group: str, query_col: str = "query_id") -> DataFrame:
    """Order of groups (sessions) by their first item in a ranking."""
    first = ranking.groupBy(query_col, group).agg(F.min("rank").alias("first_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy("first_rank", group)))


def hash_sample(rows: DataFrame, key: str, strata: list[str], limit: int | None = None, share: float | None = None,
                seed: int = 0) -> DataFrame:
    """A seeded sample per stratum: the first rows in the order of md5(seed:key), `limit` of them or a rounded share."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    if limit is not None:
        return top_per_group(rows.withColumn("__h", order), strata, [F.col("__h"), F.col(key)], limit, "__rank").drop("__h", "__rank")
    # A share's cut-off is found on block counts: the hash splits a stratum evenly, so no stratum is sorted whole.
    hashed = rows.withColumn("__h", order).withColumn("__block", F.substring("__h", 1, 3))
    counts = hashed.groupBy(*strata, "__block").agg(F.count(F.lit(1)).alias("__n"))
    by_block = Window.partitionBy(*strata).orderBy("__block")
    placed = counts.select(*strata, "__block",
                           (F.sum("__n").over(by_block) - F.col("__n")).alias("__before"),
                           F.round(F.sum("__n").over(Window.partitionBy(*strata)) * F.lit(share)).cast("long").alias("__wanted"))
    inside = Window.partitionBy(*strata, "__block").orderBy("__h", key)
    return (hashed.join(placed, [*strata, "__block"])
            .where(F.col("__before") < F.col("__wanted"))
            .withColumn("__at", F.row_number().over(inside) + F.col("__before"))
            .where(F.col("__at") <= F.col("__wanted"))
            .drop("__h", "__block", "__before", "__wanted", "__at"))


def newest_first(rows: DataFrame, group: list[str], at: Column, limit: int, key: str) -> DataFrame:
    return top_per_group(rows, group, [at.desc(), F.col(key)], limit, "place")
