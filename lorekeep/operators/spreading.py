"""Associative recall: named entities, seeds, spreading activation and memory scores, all queries at once.

Links are stored in both directions as (node, neighbour, kind). A hop is one join of the frontier with the links, a
top-K per (query, node) and one aggregate per (query, neighbour). Names, nodes and inputs grow with the memory, and their files are far smaller than
their rows, so none of them is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import IGNORED_NAMES, RECALL_STOP_WORDS, ngrams, norm, norm_words, time_window
from ..session import cut_lineage, drop_table
from .graph import specificity
from .nearest import vector_topk
from .skew import salted_join, shuffled, top_per_group

SEED_SCALE = 12  # decimals at which activations count as equal


@dataclass
class SpreadParams:
    """Defaults of associative recall; an arm of an evaluation overrides some of them. Names and numbers that arm specs use."""

    hops: int = 2
    decay: float = 0.6
    top_k: int = 8
    threshold: float = 0.05
    max_nodes: int = 300
    fan0: int = 5
    seed_k: int = 10
    seed_temp: float = 0.05
    entity_min_sim: float = 0.0
    name_seed: float = 1.0
    round_seed_temp: float = 10.0
    round_seed_n: int = 30
    carry_decay: float = 0.5
    combine: str = "sum"
    relevance_floor: float = 0.5
    temporal_miss: float = 0.5
    confidence_floor: float = 0.5
    edge_weights: dict = field(default_factory=lambda: {"MENTIONS": 1.0, "IN_ROUND": 1.0, "IS_A": 0.4, "IN_SESSION": 0.3})
    state_weights: dict = field(default_factory=lambda: {
        "stated": 1.0, "intended": 0.9, "negated": 0.9, "assistant_said": 0.9, "hypothetical": 0.6})
    source_weights: dict = field(default_factory=dict)


def clinical_params() -> SpreadParams:
    """Defaults over a clinical terminology (SNOMED CT relationship types as link kinds)."""
    return SpreadParams(
        hops=3, combine="distinct", carry_decay=0.8,
        edge_weights={"MENTIONS": 1.0, "IN_SESSION": 0.2, "sct:116680003": 0.5, "sct:246075003": 0.9, "sct:127489000": 0.9,
                      "sct:363698007": 0.5, "sct:363714003": 0.5, "sct:726542003": 0.2},
        state_weights={"present": 1.0, "absent": 0.8, "possible": 0.7, "conditional": 0.7, "hypothetical": 0.5},
        source_weights={"lab": 1.0, "structured": 1.0, "note": 0.95, "guideline": 1.0, "ai": 0.3})


def arm_params(spec: str, base: SpreadParams | None = None) -> tuple[str, SpreadParams]:
    """An arm such as `assoc[hops=0;fan0=10;IS_A=0.2]` as (name, parameters)."""
    name, _, rest = spec.partition("[")
    params = base or SpreadParams()
    for part in filter(None, rest.rstrip("]").split(";")):
        key, _, value = part.partition("=")
        if key in params.edge_weights:
            params.edge_weights[key] = float(value)
        elif key in params.state_weights:
            params.state_weights[key] = float(value)
        elif hasattr(params, key) and not isinstance(getattr(params, key), dict):
            setattr(params, key, type(getattr(params, key))(value))
        else:
            raise ValueError(f"unknown parameter {key} in {spec}")
    return name, params


def _weight(kind: Column, weights: dict, default: float) -> Column:
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(default))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dot product of unit vectors, 0 when one is missing."""
    out = np.zeros(len(a))
    usable = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and len(x) == len(y) and len(x)]
    if usable:
        left, right = a.iloc[usable], b.iloc[usable]
        if len({len(x) for x in left}) == 1:
            out[usable] = np.einsum("ij,ij->i", np.vstack(left.to_list()).astype(float), np.vstack(right.to_list()).astype(float))
        else:
            out[usable] = [float(np.dot(x, y)) for x, y in zip(left, right)]
    return pd.Series(out)


# --- Names ---
def named_entities(texts: DataFrame, names: DataFrame, longest: int = 6) -> DataFrame:
    """(query_id, node): entities whose normalised name is a run of 1..6 words of the text.

    names: (name, node), normalised. Runs of stop words never name anything. Runs are cut where the text is read and
    only (query, run) pairs travel.
    """
    grams = texts.select("query_id", *(["scope"] if "scope" in texts.columns else []),
                         F.explode(ngrams(norm_words(F.col("text")), longest, RECALL_STOP_WORDS)).alias("name"))
    keys = ["scope", "name"] if "scope" in texts.columns and "scope" in names.columns else ["name"]
    return grams.join(shuffled(names), keys).select("query_id", "node").distinct()


def usable_name(name: Column) -> Column:
    """Whether a normalised name may name an entity."""
    return (F.length(name) > 0) & ~name.isin(IGNORED_NAMES) & ~name.isin(RECALL_STOP_WORDS)


def entity_names(entities: DataFrame) -> DataFrame:
    """(scope, name, node) of entities and their synonyms; the smallest node keeps a disputed name."""
    all_names = entities.select("scope", "node", F.explode(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("n"))
    return (all_names.select("scope", "node", norm(F.col("n")).alias("name")).where(usable_name(F.col("name")))
            .groupBy("scope", "name").agg(F.min("node").alias("node")))


# --- Links ---
def pair_links(links: DataFrame) -> DataFrame:
    """One kind per unordered pair (the last written wins), seen from both ends, with each node's degree."""
    one = (links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind", "at")
           .groupBy("a", "b").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind")))
    both = one.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "kind").unionByName(
        one.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("neighbour"), "kind"))
    return both


def weighted_links(links: DataFrame, params: SpreadParams, ranked_by_input: bool) -> DataFrame:
    """(node, neighbour, weight, spec) of links that pass activation.

    Specificity counts all links of a node. When no input vector reorders neighbours, a node can only ever pass
    activation to its first top_k + 1 neighbours (one may be the parent), so a hub keeps just those.
    """
    degree = links.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    spec = degree.select("node", specificity(F.col("degree"), params.fan0).alias("spec"))
    live = links.withColumn("weight", _weight(F.col("kind"), params.edge_weights, 0.0)).where("weight > 0").select("node", "neighbour", "weight")
    if not ranked_by_input:
        live = top_per_group(live, ["node"], [F.col("weight").desc(), F.col("neighbour").desc()], params.top_k + 1).drop("rank")
    return live.join(shuffled(spec), "node")


# --- Spreading ---
def _hop(frontier: DataFrame, links: DataFrame, keys: list[str], params: SpreadParams, vectors) -> DataFrame:
    """(keys, node, neighbour, gain, path) of one hop from a frontier of (keys, node, a, parent, path)."""
    live = frontier.where(F.col("a") >= params.threshold)
    rows = live.join(links, "node") if vectors is None else salted_join(links, live, ["node"])
    rows = rows.where(F.col("parent").isNull() | (F.col("neighbour") != F.col("parent")))
    if vectors is None:
        rows = rows.withColumn("value", F.col("weight"))
    else:
        queries, nodes = vectors
        rows = (rows.join(shuffled(queries.select("query_id", F.col("vec").alias("__q"))), "query_id")
                .join(shuffled(nodes.select(F.col("node").alias("neighbour"), F.col("vec").alias("__n"))), "neighbour", "left")
                .withColumn("value", F.col("weight") * (1 + similarity("__q", "__n"))).drop("__q", "__n"))
    best = top_per_group(rows, [*keys, "node"], [F.round("value", SEED_SCALE).desc(), F.col("neighbour").desc()], params.top_k)
    return best.select(*keys, "node", "neighbour", "path", (F.col("a") * params.decay * F.col("spec") * F.col("weight")).alias("gain"))


def _received(gains: DataFrame, keys: list[str], total: Column) -> DataFrame:
    # The strongest contributor is the parent, ties to the smaller id.
    return (gains.groupBy(*keys, "neighbour").agg(total.alias("a"), F.min_by(F.struct("node", "path"), F.struct(-F.col("gain"), F.col("node"))).alias("from"))
            .select(*keys, F.col("neighbour").alias("node"), "a", F.col("from.node").alias("parent"),
                    F.concat("from.path", F.array("neighbour")).alias("path")))


def spread_sum(seeds: DataFrame, links: DataFrame, params: SpreadParams, vectors=None) -> DataFrame:
    """(query_id, node, activation, path): a node adds up everything it receives; the next hop carries only what was
    received in this one. seeds: (query_id, node, activation, why)."""
    table = cut_lineage(weighted_links(links, params, vectors is not None))
    act = cut_lineage(seeds.select("query_id", "node", F.col("activation").cast("double").alias("a"), F.lit(None).cast("string").alias("parent"), F.array("why").alias("path")))
    frontier = act
    for _ in range(params.hops):
        got = _received(_hop(frontier, table, ["query_id"], params, vectors), ["query_id"], F.sum("gain"))
        new = got.select("query_id", "node", F.col("a").alias("g"), F.col("parent").alias("p"), F.col("path").alias("r"))
        merged = act.join(new, ["query_id", "node"], "full_outer").select(
            "query_id", "node", (F.coalesce("a", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("a"),
            F.when(F.col("a").isNotNull(), F.col("parent")).otherwise(F.col("p")).alias("parent"),
            F.when(F.col("a").isNotNull(), F.col("path")).otherwise(F.col("r")).alias("path"), "g")
        capped = cut_lineage(top_per_group(merged, ["query_id"], [F.round("a", SEED_SCALE).desc(), F.col("node")], params.max_nodes).drop("rank"))
        act = capped.drop("g")
        frontier = capped.where(F.col("g").isNotNull()).select("query_id", "node", F.col("g").alias("a"), "parent", "path")
    return act.select("query_id", "node", F.col("a").alias("activation"), "path")


def spread_distinct(seeds: DataFrame, links: DataFrame, params: SpreadParams, vectors=None) -> DataFrame:
    """(query_id, node, activation, path): each seed spreads alone and a node adds up its best path from each seed."""
    table = cut_lineage(weighted_links(links, params, vectors is not None))
    keys = ["query_id", "seed"]
    reach = cut_lineage(seeds.select("query_id", F.col("node").alias("seed"), "node", F.col("activation").cast("double").alias("a"),
                                     F.lit(None).cast("string").alias("parent"), F.array("why").alias("path")))
    frontier, stored = reach, reach
    for hop in range(params.hops):
        # Written before the best are taken: what the choice of neighbours moved is gone when the gains move.
        gains = cut_lineage(_hop(frontier, table, keys, params, vectors))
        if hop == params.hops - 1:
            drop_table(table)
        got = _received(gains, keys, F.max("gain"))
        new = got.select(*keys, "node", F.col("a").alias("g"), F.col("parent").alias("p"), F.col("path").alias("r"))
        better = F.col("g").isNotNull() & (F.col("g") > F.coalesce("a", F.lit(0.0)))
        merged = cut_lineage(reach.join(new, [*keys, "node"], "full_outer").select(
            *keys, "node", F.when(better, F.col("g")).otherwise(F.col("a")).alias("a"),
            F.when(better, F.col("p")).otherwise(F.col("parent")).alias("parent"),
            F.when(better, F.col("r")).otherwise(F.col("path")).alias("path"), better.alias("new")))
        drop_table(gains)
        drop_table(stored)
        stored = merged
        reach = merged.drop("new")
        frontier = merged.where("new").drop("new")
    total = reach.groupBy("query_id", "node").agg(F.sum("a").alias("activation"), F.min_by("path", F.struct(-F.col("a"), F.col("seed"))).alias("path"))
    return top_per_group(total, ["query_id"], [F.round("activation", SEED_SCALE).desc(), F.col("node")], params.max_nodes).drop("rank")


def spread(seeds: DataFrame, links: DataFrame, params: SpreadParams, vectors=None) -> DataFrame:
    return (spread_distinct if params.combine == "distinct" else spread_sum)(seeds, links, params, vectors)


# --- Seeds ---
def seed_nodes(inputs: DataFrame, nodes: DataFrame, names: DataFrame, params: SpreadParams, round_ranks: DataFrame | None = None,
               carried: DataFrame | None = None) -> DataFrame:
    """(query_id, node, activation, why): names, nearest entities and memories, another retriever's rounds, carried cues.

    inputs: query_id, scope, text, vec; nodes: scope, node, kind, label, vec; round_ranks: query_id, node, rank from 1;
    carried: query_id, node, activation.
    """
    parts = [named_entities(inputs, names).select("query_id", "node", F.lit(params.name_seed).alias("activation"), F.lit("").alias("mark"))]
    asked = inputs.where(F.col("vec").isNotNull()).select("query_id", "scope", "vec")
    for kind in ("entity", "memory"):
        rows = nodes.where((F.col("kind") == kind) & F.col("vec").isNotNull()).select("scope", "node", "vec")
        near = vector_topk(rows, asked, params.seed_k, "node", "query_id", ["scope"])
        best = near.where("rank = 1").select("query_id", F.col("score").alias("best"))
        soft = F.greatest(F.lit(0.0), F.col("score")) * F.exp((F.col("score") - F.col("best")) / params.seed_temp)
        kept = near.join(shuffled(best), "query_id").where(F.lit(kind == "memory") | (F.col("score") >= params.entity_min_sim))
        parts.append(kept.select("query_id", "node", soft.alias("activation"), F.lit("~").alias("mark")))
    if round_ranks is not None:
        parts.append(round_ranks.where(F.col("rank") <= params.round_seed_n).select(
            "query_id", "node", F.exp(-(F.col("rank") - 1) / params.round_seed_temp).alias("activation"), F.lit("#").alias("mark")))
    if carried is not None:
        parts.append(carried.select("query_id", "node", (F.col("activation") * params.carry_decay).alias("activation"), F.lit("+").alias("mark")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.where("activation > 0").groupBy("query_id", "node").agg(F.max("activation").alias("activation"), F.max_by("mark", F.struct("activation", "mark")).alias("mark"))
    return best.join(shuffled(nodes.select("node", "label")), "node").select("query_id", "node", "activation", F.concat("mark", "label").alias("why"))


# --- Scores ---
def score_memories(active: DataFrame, inputs: DataFrame, nodes: DataFrame, params: SpreadParams) -> DataFrame:
    """Ranked memories and rounds: activation x temporal x confidence x provenance x relevance; entities by activation.

    nodes: node, kind, label, text, vec, date, state, source, confidence, session; inputs: query_id, text, vec, date.
    """
    joined = active.join(shuffled(nodes.drop("scope")), "node").join(
        shuffled(inputs.select("query_id", F.col("vec").alias("__q"), time_window(F.col("text"), F.col("date")).alias("__w"))), "query_id")
    sim = similarity("__q", "vec")
    rows = joined.withColumn("similarity", sim).drop("__q", "vec")
    inside = F.col("__w").isNull() | ((F.col("date") >= F.col("__w.start")) & (F.col("date") <= F.col("__w.end")))
    temporal = F.when(inside, 1.0).otherwise(params.temporal_miss)
    confidence = params.confidence_floor + (1 - params.confidence_floor) * F.coalesce("confidence", F.lit(1.0))
    provenance = _weight(F.coalesce("state", F.lit("")), params.state_weights, 1.0) * _weight(F.coalesce("source", F.lit("")), params.source_weights, 1.0)
    relevance = params.relevance_floor + (1 - params.relevance_floor) * F.greatest(F.lit(0.0), F.col("similarity"))
    score = F.when(F.col("kind") == "entity", F.col("activation")).otherwise(F.col("activation") * temporal * confidence * provenance * relevance)
    return rows.where(F.col("kind").isin("entity", "memory", "round")).withColumn("score", score).drop("__w")
