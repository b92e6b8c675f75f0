"""Bounded exploration of the graph for many needs at once: index candidates, decisions, leaf checks, one expansion hop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import stable_id
from ..functions.text import terms, words
from ..session import cut_lineage
from . import fusion, graph, inference
from .nearest import hybrid_topk, rank_inputs
from .skew import top_per_group
from .spreading import similarity


@dataclass
class ExploreParams:
    candidate_limit: int = 20
    root_children: int = 8
    children: int = 3
    floor: int = 2
    nodes: int = 60
    breadth: bool = False


def pair_scores(pairs: DataFrame, nodes: DataFrame, needs: DataFrame, lexical: float = 0.5, semantic: float = 0.35, label: float = 0.1,
                hit: float = 0.0025, hit_cap: int = 20) -> DataFrame:
    """The hybrid score of given (need, node) pairs. nodes: `rank_inputs`; needs: need_key, terms, vec."""
    rows = (pairs.join(needs.select("need_key", "terms", F.col("vec").alias("__q")), "need_key")
            .join(nodes.select("node_id", "label_words", "content_words", F.col("vec").alias("__n"), "hits"), "node_id"))
    size = F.greatest(F.size("terms"), F.lit(1))
    in_label = F.array_intersect("terms", "label_words")
    found = F.size(F.array_union(in_label, F.array_intersect("terms", "content_words")))
    score = (lexical * found / size + semantic * F.greatest(F.lit(0.0), similarity("__q", "__n")) + label * F.size(in_label) / size
             + hit * F.least(F.coalesce("hits", F.lit(0)), F.lit(hit_cap)))
    return rows.withColumn("score", F.round(score, 9)).drop("__q", "__n", "terms", "label_words", "content_words", "hits")


def root_candidates(needs: DataFrame, questions: DataFrame, inputs: DataFrame, limit: int) -> DataFrame:
    """(need_key, node_id, score, rank): index hits for the need and for the question, best score per node."""
    # A need that restates the question shares its search; both kinds are searched together, so the nodes are read once.
    same = F.lower(F.trim("description")) == F.lower(F.trim("text"))
    differing = needs.join(questions.select("query_id", "text"), "query_id").where(~same).select("need_key", F.concat(F.lit("q:"), F.col("query_id").cast("string")).alias("query_id"))
    other = questions.select(F.concat(F.lit("q:"), F.col("query_id").cast("string")).alias("query_id"), "text", "vec").join(differing.select("query_id").distinct(), "query_id", "left_semi")
    searched = needs.select(F.concat(F.lit("n:"), "need_key").alias("query_id"), F.col("description").alias("text"), "vec").unionByName(other)
    found = cut_lineage(hybrid_topk(inputs, searched, limit))
    own = found.where(F.col("query_id").startswith("n:")).withColumn("need_key", F.substring("query_id", F.lit(3), F.length("query_id")))
    lists = [own.select("need_key", "node_id", "score"), found.join(differing, "query_id").select("need_key", "node_id", "score")]
    return fusion.best_per_need(lists, limit, "need_key", "node_id")


def decide(candidates: DataFrame, kinds: DataFrame, policy: Callable[[Column, Column], Column], breadth: int, floor: int, key: list[str]) -> DataFrame:
    """Candidates with `action` and `reason`: the policy's choice, a floor when all were pruned, the breadth cap by rank."""
    rows = candidates.join(kinds, "node_id").withColumn("wanted", policy(F.col("score"), F.col("retrievable")))
    kept = rows.groupBy(*key).agg(F.bool_and(F.col("wanted") == "PRUNE").alias("__none"))
    rows = rows.join(kept, key).withColumn("wanted", F.when(
        F.col("__none") & (F.col("rank") <= floor), F.when(F.col("retrievable"), F.lit("SELECT")).otherwise(F.lit("EXPAND"))).otherwise(F.col("wanted")))
    taken = F.sum(F.when(F.col("wanted") != "PRUNE", 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("rank"))
    action = F.when((F.col("wanted") == "PRUNE") | (F.col("taken") > breadth), F.lit("PRUNE")).when(~F.col("retrievable"), F.lit("EXPAND")).otherwise(F.col("wanted"))
    reason = F.when(F.col("wanted") == "PRUNE", F.lit("policy")).when(F.col("taken") > breadth, F.lit("branch_budget"))
    return rows.withColumn("taken", taken).withColumn("action", action).withColumn("reason", reason).drop("wanted", "taken", "__none")


def within_budget(branches: DataFrame, left: DataFrame | int) -> DataFrame:
    """The branches a query's node budget reaches, best priority first; ties by need, then node."""
    order = [F.col("score").desc(), F.col("need_key"), F.col("node_id")]
    if isinstance(left, int):
        return top_per_group(branches, ["query_id"], order, left, "place").drop("place")
    # What is left differs by query, so every branch gets its place; a query has at most its candidates, never the corpus.
    ranked = branches.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).join(left, "query_id")
    return ranked.where(F.col("place") <= F.col("left")).drop("place", "left")


def budget_left(asked: DataFrame, nodes: int, *spent: DataFrame) -> DataFrame:
    """(query_id, left): what each query may still visit."""
    rows = asked.select("query_id", F.lit(0).alias("__n"))
    for used in spent:
        rows = rows.unionByName(used.select("query_id", F.lit(1).alias("__n")))
    return rows.groupBy("query_id").agg((F.lit(nodes) - F.sum("__n")).cast("int").alias("left"))


def explore(needs: DataFrame, questions: DataFrame, nodes: DataFrame, edges: DataFrame, provenance: DataFrame,
            params: ExploreParams | None = None, policy=inference.score_policy, relevance=None, starts: DataFrame | None = None,
            visited: DataFrame | None = None) -> dict[str, DataFrame]:
    """Evidence and branches of one pass.

    needs: query_id, need_id, need_no, description, vec; questions: query_id, text, vec; nodes: visible content nodes
    (id, kind, label, aliases, text, summary, routing_summary, embedding, hits, retrieval_leaf); provenance: node_id,
    document_id (first source document) for nodes that have an original source. `relevance` adds `relevant` and
    `relevance` to (need_key, node_id, description, text, text_words) rows. `starts`: (need_key, node_id, action) skips the root.
    """
    p = params or ExploreParams()
    relevance = relevance or lexical_check
    needs = cut_lineage(needs.withColumn("need_key", F.concat_ws("|", "query_id", "need_id")).withColumn("terms", terms(F.col("description"))))
    inputs = cut_lineage(rank_inputs(nodes.withColumnRenamed("id", "node_id")))
    def leaves(branches):
        """The leaves that branches name; their words are cut once and the checks only intersect them."""
        rows = nodes.where(F.col("kind").isin("Chunk", "Assertion", "Document") & (F.length("text") > 0)).select(F.col("id").alias("node_id"), "kind", "text")
        rows = rows.join(branches.select("node_id").distinct(), "node_id", "left_semi")
        return rows.withColumn("text_words", words(F.col("text")))
    kinds = cut_lineage(nodes.select(F.col("id").alias("node_id"), graph.retrievable(F.col("kind"), F.col("text"), F.col("retrieval_leaf")).alias("retrievable")))
    owner = needs.select("need_key", "query_id")

    if starts is None:
        found = decide(root_candidates(needs, questions, inputs, p.candidate_limit), kinds, policy, p.root_children, p.floor, ["need_key"])
    else:
        found = starts.withColumn("score", F.lit(1.0)).withColumn("rank", F.lit(1)).join(kinds, "node_id").withColumn("reason", F.lit(None).cast("string"))
    root = found.join(owner, "need_key")
    if visited is not None:
        root = root.join(visited.select("need_key", "node_id"), ["need_key", "node_id"], "left_anti")
    root = cut_lineage(root.select("query_id", "need_key", "node_id", "score", "rank", "retrievable", "action", "reason"))

    selected = within_budget(root.where("action = 'SELECT'"), p.nodes)
    near_root = cut_lineage(leaves(root.where("action <> 'PRUNE'")))
    first = cut_lineage(check(selected, needs, near_root, provenance, relevance))

    # One hop of expansion, only for needs the leaves left without evidence (every need in a dossier).
    waiting = root.where("action = 'EXPAND'")
    if not p.breadth:
        waiting = waiting.join(first.select("need_key").distinct(), "need_key", "left_anti")
    asked = needs.select("query_id").distinct()
    expanded = cut_lineage(within_budget(waiting, budget_left(asked, p.nodes, selected)))
    # A node that is opened is read as well: leaves chosen for expansion are evidence like selected ones.
    first = cut_lineage(first.unionByName(check(expanded, needs, near_root, provenance, relevance)))
    near = (graph.both_directions(edges).join(expanded.select(F.col("node_id").alias("node"), "need_key").distinct(), "node")
            .select("need_key", F.col("node").alias("parent_id"), F.col("neighbour").alias("node_id")).distinct()
            .join(root.where("action <> 'PRUNE'").select("need_key", "node_id"), ["need_key", "node_id"], "left_anti")
            .join(kinds.select("node_id"), "node_id", "left_semi"))
    scored = top_per_group(pair_scores(near, inputs, needs), ["need_key", "parent_id"], [F.col("score").desc(), F.col("node_id")], p.candidate_limit)
    children = decide(scored, kinds, policy, p.children, 0, ["need_key", "parent_id"]).join(owner, "need_key")
    best = Window.partitionBy("need_key", "node_id").orderBy(F.col("score").desc(), "parent_id")
    children = cut_lineage(children.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r"))
    chosen = within_budget(children.where("action = 'SELECT'"), budget_left(asked, p.nodes, selected, expanded))
    second = check(chosen, needs, leaves(chosen), provenance, relevance)

    hits = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    evidence = merge_evidence(hits, needs)
    reached = selected.unionByName(expanded).select("need_key", "node_id").withColumn("__in", F.lit(True))
    status = (F.when(F.col("action") == "PRUNE", F.col("reason")).when(F.col("__in"), F.lit("explored"))
              .when(F.col("action") == "EXPAND", F.lit("need_has_evidence")).otherwise(F.lit("global_node_budget")))
    branches = (root.join(reached, ["need_key", "node_id"], "left")
                .select("query_id", "need_key", "node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("depth"), "score", "action", status.alias("outcome"))
                .unionByName(children.join(chosen.select("need_key", "node_id").withColumn("__in", F.lit(True)), ["need_key", "node_id"], "left")
                             .select("query_id", "need_key", "node_id", "parent_id", F.lit(2).alias("depth"), "score", "action",
                                     F.when(F.col("action") == "EXPAND", F.lit("expansion_depth")).otherwise(status).alias("outcome"))))
    return {"evidence": evidence, "branches": branches, "visited": branches.where("action <> 'PRUNE'").select("need_key", "node_id")}


def lexical_check(pairs: DataFrame) -> DataFrame:
    """Offline relevance: the need's words occur; 0.8 when relevant, 0.1 otherwise."""
    relevant = inference.lexical_relevance(F.col("description"), F.col("text_words"))
    return pairs.withColumn("relevant", relevant).withColumn("relevance", F.when(F.col("relevant"), 0.8).otherwise(0.1))


def check(branches: DataFrame, needs: DataFrame, leaves: DataFrame, provenance: DataFrame, relevance) -> DataFrame:
    """Selected leaves that answer their need and have a source: evidence per (need, node).

    leaves: node_id, kind, text, text_words."""
    pairs = (branches.join(needs.select("need_key", "need_id", "need_no", "description"), "need_key")
             .join(leaves, "node_id")
             .join(provenance.select("node_id", "document_id"), "node_id"))
    return relevance(pairs).where("relevant").select("query_id", "need_key", "need_id", "need_no", "node_id", "kind", "text", "document_id", "relevance", "score")


def merge_evidence(hits: DataFrame, needs: DataFrame) -> DataFrame:
    """One row per (query, node): the ids of all needs it answers, the relevance it was first found with."""
    found = F.struct("pass", (-F.col("score")).alias("s"), "need_no", "node_id")
    return (hits.groupBy("query_id", "node_id").agg(
        F.array_sort(F.collect_set("need_id")).alias("need_ids"), F.min(found).alias("found"),
        F.min_by(F.struct("kind", "text", "document_id", "relevance"), found).alias("e"))
        .select("query_id", stable_id("evidence", F.col("node_id").cast("string")).alias("evidence_id"), "node_id", "need_ids", "found", "e.*"))


def with_contradictions(evidence: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds, next to each found item, the counterparts that contradict it, and each item's list of contradicting ids."""
    against = graph.contradictions(edges).select(F.col("node").alias("node_id"), F.col("neighbour").alias("other_id"))
    pulled = (evidence.join(against, "node_id").join(nodes.where(F.length("text") > 0).select(F.col("id").alias("other_id"), F.col("text").alias("t")), "other_id"))
    extra = pulled.join(evidence.select("query_id", F.col("node_id").alias("other_id")), ["query_id", "other_id"], "left_anti").groupBy("query_id", "other_id").agg(
        F.min("found").alias("found"), F.max_by(F.struct("need_ids", "relevance", "document_id", "t"), F.struct("relevance", "evidence_id")).alias("p")).select(
        "query_id", F.concat(F.lit("contradiction:"), "other_id").alias("evidence_id"), F.col("other_id").alias("node_id"), "p.need_ids", "found",
        F.lit("Assertion").alias("kind"), F.col("p.t").alias("text"), "p.document_id", "p.relevance")
    rows = evidence.unionByName(extra)
    ids = rows.select("query_id", F.col("node_id").alias("other_id"), F.col("evidence_id").alias("other_evidence"))
    lists = (rows.select("query_id", "node_id").join(against, "node_id").join(ids, ["query_id", "other_id"])
             .groupBy("query_id", "node_id").agg(F.array_sort(F.collect_set("other_evidence")).alias("contradicts")))
    return rows.join(lists, ["query_id", "node_id"], "left").withColumn("contradicts", F.coalesce("contradicts", F.array().cast("array<string>")))


def second_pass_starts(needs: DataFrame, fresh: DataFrame, known: DataFrame, limit: int = 8) -> DataFrame:
    """(need_key, node_id, action): the new leaves nearest to each need as SELECT, known documents as EXPAND.

    fresh: need_key, node_id, score of leaves fetched for a need; known: need_key, node_id.
    """
    near = top_per_group(fresh, ["need_key"], [F.col("score").desc(), F.col("node_id")], limit)
    return near.select("need_key", "node_id", F.lit("SELECT").alias("action")).unionByName(
        known.select("need_key", "node_id", F.lit("EXPAND").alias("action"))).dropDuplicates(["need_key", "node_id"])
