"""Settling repeated and changed statements: exact near-duplicate links inside groups, one survivor per linked set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import numbers
from ..session import cut_lineage
from .components import connected_components
from .skew import salted_join, shuffled, top_per_group

BLOCK = 1024


def _forest(size: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the linked positions: enough to join them, never more links than rows."""
    parent = list(range(size))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            kept.append((i, j))
    return kept


def similar_links(items: DataFrame, group: list[str], same: float = 0.85, same_text: float = 0.92) -> DataFrame:
    """(a, b) links that join exactly the statements a comparison of all pairs in a group would join.

    Two statements link when their figures agree and their cosine reaches `same` (`same_text` without figures), or
    when both hold different figures, the cosine reaches `same` and the dates differ. items: id, group, vec (unit),
    figures (text), date. Copies meet through one representative, statements with and without figures can never link,
    and blocks of bounded size are compared pairwise, each pair handing on a spanning forest only.
    """
    # A zero vector has no direction, so it is like nothing, not even another zero vector.
    usable = items.where(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0)).withColumn("__v", F.xxhash64("vec"))
    by_copy = [*group, "__v", "figures"]
    heads = usable.groupBy(*by_copy, "date").agg(F.min("id").alias("head"))
    first = heads.groupBy(*by_copy).agg(F.min("head").alias("first"))
    own = usable.join(shuffled(heads), [*by_copy, "date"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    across = heads.join(shuffled(first), by_copy).select(F.col("head").alias("a"), F.col("first").alias("b"))
    copies = own.unionByName(across).where("a <> b")

    lead = usable.join(shuffled(heads.select(F.col("head").alias("id"))), "id", "left_semi").withColumn("__f", F.col("figures") != "")
    keys = [*group, "__f"]
    sized = lead.join(lead.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__blocks")), keys)
    placed = sized.withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
    spread = (placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
              .withColumn("__lo", F.least("__block", "__other")).withColumn("__hi", F.greatest("__block", "__other")))
    id_type = items.schema["id"].dataType.simpleString()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        low = np.flatnonzero((pdf["__block"] == pdf["__lo"]).to_numpy())
        high = np.flatnonzero((pdf["__block"] == pdf["__hi"]).to_numpy())
        vectors = np.vstack(pdf["vec"].to_list()).astype(np.float64)
        cos = np.round(vectors[low] @ vectors[high].T, 9)
        figures, dates = pdf["figures"].to_numpy(), pdf["date"].to_numpy()
        equal = figures[low][:, None] == figures[high][None, :]
        with_figures = (figures[low] != "")[:, None]
        repeat = equal & (cos >= np.where(with_figures, same, same_text))
        change = ~equal & with_figures & (figures[high] != "")[None, :] & (cos >= same) & (dates[low][:, None] != dates[high][None, :])
        i, j = np.nonzero(repeat | change)
        links = _forest(len(pdf), ((low[x], high[y]) for x, y in zip(i, j) if low[x] != high[y]))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": pd.Series([ids[x] for x, _ in links], dtype=object),
                             "b": pd.Series([ids[y] for _, y in links], dtype=object)})

    near = (spread.select(*keys, "__lo", "__hi", "__block", "id", "vec", "figures", F.col("date").cast("string").alias("date"))
            .groupBy(*keys, "__lo", "__hi").applyInPandas(compare, f"a {id_type}, b {id_type}"))
    return copies.unionByName(near)


def settle(items: DataFrame, group: list[str], same: float = 0.85, same_text: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """(survivors, members). items: id, group columns, text, date, score, vec.

    Of each linked set the newest survives; `seen` counts statements with its figures, `before` keeps the latest words
    of up to two replaced values. members: (survivor_id, id) of everything merged, as rows.
    """
    marked = cut_lineage(items.withColumn("figures", F.array_join(numbers(F.col("text")), "|")))
    sets = connected_components(marked.select("id"), similar_links(marked, group, same, same_text))
    rows = marked.drop("vec").join(shuffled(sets), "id")
    newest = rows.groupBy("component").agg(
        F.max_by(F.struct("id", "text", "date", "figures", *group), F.struct("date", "score", "id")).alias("n"), F.max("score").alias("score"))
    joined = salted_join(rows.select("component", "id", "text", "date", "figures"),
                         newest.select("component", F.col("n.id").alias("survivor_id"), F.col("n.figures").alias("kept_figures")), ["component"])
    seen = joined.where("figures = kept_figures").groupBy("component").agg(F.count(F.lit(1)).alias("seen"))
    replaced = joined.where("figures <> kept_figures").groupBy("component", "figures").agg(F.max_by(F.struct("date", "text"), F.struct("date", "id")).alias("r"))
    before = top_per_group(replaced, ["component"], [F.col("r.date").desc(), F.col("figures")], 2).groupBy("component").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("r.text").alias("t")))), lambda x: x["t"]).alias("before"))
    survivors = newest.join(shuffled(seen), "component").join(shuffled(before), "component", "left").select(
        "n.id", *[f"n.{g}" for g in group], "n.text", "n.date", "score", "seen", F.coalesce("before", F.array().cast("array<string>")).alias("before"))
    return survivors, joined.select("survivor_id", "id")


def newest_statements(items: DataFrame, scope: str = "scope", limit: int | None = None) -> DataFrame:
    """Statements of a scope, newest first by `place`: all of them, or the `limit` newest for a listing."""
    order = [F.col("date").desc(), F.col("id")]
    if limit is not None:
        return top_per_group(items, [scope], order, limit, "place")
    return items.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))
