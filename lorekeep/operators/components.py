"""Connected components by alternating hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .skew import shuffled


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each node's connected set. `links` are (a, b) pairs.

    A round contracts the graph: every node takes the smallest id among itself and its neighbours, links are rewritten
    to those ids, and links inside one group disappear. Long chains shrink geometrically, a hub's links collapse in the
    first round, and aggregates combine before each shuffle. Every round removes at least one group of each linked set, so
    the rounds end by themselves.
    """
    ids = nodes.select("id").distinct()
    labels = ids.withColumn("component", F.col("id"))
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = cut_lineage(pairs)
    while True:
        if not pairs.take(1):
            return labels
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        # Pointer jumping inside the round: follow the chosen parent until it no longer changes.
        parent = cut_lineage(smallest.select(F.col("a").alias("id"), F.col("to")))
        while True:
            up = parent.select(F.col("id").alias("to"), F.col("to").alias("next"))
            jumped = cut_lineage(parent.join(shuffled(up), "to", "left").select(
                "id", F.coalesce("next", "to").alias("to"), (F.coalesce("next", "to") != F.col("to")).alias("moved")))
            moved = jumped.where("moved").take(1)
            parent = jumped.drop("moved")
            if not moved:
                break
        labels = cut_lineage(labels.join(shuffled(parent.select(F.col("id").alias("component"), "to")), "component", "left")
                             .select("id", F.coalesce("to", "component").alias("component")))
        first = parent.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        second = parent.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        pairs = cut_lineage(pairs.join(shuffled(first), "a").join(shuffled(second), "b")
                            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                            .where("a <> b").distinct())
