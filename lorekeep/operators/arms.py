"""Spreading activation for all arms of an evaluation in one pass: parameters are data, not calls.

The frontier carries its arm's name; a hop joins it once with the links and looks up what the arm says: weights of the kinds of links, fan-out, decay, how many neighbours
pass, and below which activation nothing does. Links are read and pruned once: whatever its weights, an arm takes at most its `top_k` (and
the parent's) neighbours of one kind, so a node keeps the largest `top_k` + 1 of each kind over all arms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, drop_table, is_empty
from .skew import top_per_group
from .spreading import SEED_SCALE, SpreadParams, arm_params

NUMBERS = ("hops", "decay", "top_k", "threshold", "max_nodes", "fan0")
ARM = "arm string, hops int, decay double, top_k int, threshold double, max_nodes int, fan0 double, weights map<string,double>"


def arm_table(spark: SparkSession, specs: list[str], base=SpreadParams) -> DataFrame:
    """One row of parameters per arm, from specs such as `assoc[hops=1;fan0=10;IS_A=0.2]`; an arm is named by its whole spec."""
    rows = []
    for spec in dict.fromkeys(specs):
        params = arm_params(spec, base())[1]
        values = {n: getattr(params, n) for n in NUMBERS}
        rows.append((spec, *[float(v) if n in ("decay", "threshold", "fan0") else int(v) for n, v in values.items()], {k: float(w) for k, w in params.edge_weights.items()}))
    return spark.createDataFrame(rows, ARM)


def _of(arms: DataFrame) -> tuple[dict, dict[str, Column]]:
    """The largest values of the arms, and columns that look up a row's arm: a bounded table of parameters becomes one literal map."""
    rows = arms.collect()
    fields = [F.create_map(*[x for r in rows for x in (F.lit(r["arm"]), F.lit(r[n]))]) for n in NUMBERS]
    look = {n: F.element_at(f, F.col("arm")) for n, f in zip(NUMBERS, fields)}
    weights = F.create_map(*[x for r in rows for k, w in r["weights"].items() for x in (F.lit(f"{r['arm']}\x1f{k}"), F.lit(w))])
    look["weight"] = F.coalesce(F.try_element_at(weights, F.concat_ws("\x1f", "arm", "kind")), F.lit(0.0))
    return {n: max(r[n] for r in rows) for n in NUMBERS} | {"names": [r["arm"] for r in rows]}, look


def spread_arms(seeds: DataFrame, links: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, query_id, node, activation, path) as one call of `spread_sum` per arm gives it, without vectors.

    seeds: query_id, node, activation, why; links: node, neighbour, kind, seen from both ends; arms: see `arm_table`.
    """
    most, arm = _of(arms)
    keys = ["arm", "query_id"]
    degree = links.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    pruned = top_per_group(links.select("node", "neighbour", "kind"), ["node", "kind"], [F.col("neighbour").desc()], most["top_k"] + 1).drop("rank")
    table = cut_lineage(pruned.join(degree, "node"))
    act = seeds.select(F.explode(F.array(*[F.lit(n) for n in most["names"]])).alias("arm"), "query_id", "node", F.col("activation").cast("double").alias("a"),
                       F.lit(None).cast("string").alias("parent"), F.array("why").alias("path"))
    act = cut_lineage(act)
    frontier, stored = act, act
    for hop in range(most["hops"]):
        live = frontier.where((F.lit(hop) < arm["hops"]) & (F.col("a") >= arm["threshold"]))
        rows = live.join(table, "node").where("parent is null or neighbour <> parent").withColumn("weight", arm["weight"]).where("weight > 0")
        best = top_per_group(rows, [*keys, "node"], [F.round("weight", SEED_SCALE).desc(), F.col("neighbour").desc()], most["top_k"], "place").where(F.col("place") <= arm["top_k"])
        # Written before they are summed: what the choice of neighbours moved is gone when the gains move.
        spec = 1 / (1 + F.log(F.greatest(F.lit(1.0), F.col("degree") / arm["fan0"])))
        gains = cut_lineage(best.select(*keys, "node", "neighbour", "path", (F.col("a") * arm["decay"] * spec * F.col("weight")).alias("gain")))
        if hop == most["hops"] - 1:
            drop_table(table)
        new = gains.groupBy(*keys, "neighbour").agg(F.sum("gain").alias("g"), F.min_by(F.struct("node", "path"), F.struct(-F.col("gain"), F.col("node"))).alias("from"))
        new = new.select(*keys, F.col("neighbour").alias("node"), "g", F.col("from.node").alias("p"), F.concat("from.path", F.array("neighbour")).alias("r"))
        held = F.col("a").isNotNull()
        merged = act.join(new, [*keys, "node"], "full_outer").select(
            *keys, "node", (F.coalesce("a", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("a"), F.when(held, F.col("parent")).otherwise(F.col("p")).alias("parent"),
            F.when(held, F.col("path")).otherwise(F.col("r")).alias("path"), "g")
        capped = cut_lineage(merged)
        drop_table(gains)
        drop_table(stored)
        # Only queries that reached more nodes than their arm keeps are ranked, which moves and sorts all they reached. Arms that have made their hops already keep what they have.
        over = cut_lineage(capped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > arm["max_nodes"]).select(*keys))
        if not is_empty(over):
            whole = capped
            ranked = top_per_group(whole.join(over, keys, "left_semi"), keys, [F.round("a", SEED_SCALE).desc(), F.col("node")], most["max_nodes"], "place")
            capped = cut_lineage(whole.join(over, keys, "left_anti").unionByName(ranked.where(F.col("place") <= arm["max_nodes"]).drop("place")))
            drop_table(whole)
        stored = capped
        act = capped.drop("g")
        frontier = capped.where("g is not null").select(*keys, "node", F.col("g").alias("a"), "parent", "path")
    return act.select(*keys, "node", F.col("a").alias("activation"), "path")


def labelled_paths(found: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """`found` with labels instead of ids in `path`, behind the mark of the seed. labels: node, label; ids without one stay."""
    steps = found.select(*keys, F.posexplode("path").alias("place", "step"))
    named = steps.join(labels.select(F.col("node").alias("step"), "label"), "step", "left")
    label = F.when(F.col("place") == 0, F.col("step")).otherwise(F.coalesce("label", "step"))
    paths = named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", label.alias("label")))), lambda s: s["label"]).alias("path"))
    return found.drop("path").join(paths, keys)
