"""Forgetting: what goes with deleted memories, documents, patients and guidelines, and nothing else.

Support counting: a node that others name goes when its last remaining namer goes. Namers are counted once; the first round reads all links, each
later one only those between nodes that are named themselves, so stored memories are not read again.
Nodes that only name each other in a circle keep each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import norm
from ..session import cut_lineage, is_empty
from .clinical import patient_facts


def fallen(supports: DataFrame, gone: DataFrame) -> DataFrame:
    """(node, round): everything that loses its last namer once the nodes in `gone` are deleted (round 0).

    supports: (namer, named). What nothing ever named stays unless it is in `gone`.
    """
    links = cut_lineage(supports.select("namer", "named").distinct())
    totals = cut_lineage(links.groupBy("named").agg(F.count(F.lit(1)).alias("namers")))
    frontier = cut_lineage(gone.select("node").distinct().withColumn("round", F.lit(0)))
    out, lost, number = frontier, None, 0
    while not is_empty(frontier):
        number += 1
        hit = links.join(frontier.select(F.col("node").alias("namer")), "namer", "left_semi").groupBy("named").agg(F.count(F.lit(1)).alias("lost"))
        lost = cut_lineage(hit if lost is None else lost.unionByName(hit).groupBy("named").agg(F.sum("lost").alias("lost")))
        empty = lost.join(totals, "named").where("lost = namers").select(F.col("named").alias("node"))
        frontier = cut_lineage(empty.join(out.select("node"), "node", "left_anti").withColumn("round", F.lit(number)))
        out = out.unionByName(frontier)
        if number == 1:
            # What falls from here on was named by something, so only links from such nodes are followed.
            links = cut_lineage(links.join(totals.select(F.col("named").alias("namer")), "namer", "left_semi"))
    return out


def forget_memories(memories: DataFrame, entities: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, entities, forgotten per scope) without the wanted memories and the entities and categories that nothing names any more.

    memories: scope, id, entities array<string>; entities: scope, name, is_a array<string>; wanted: scope, id. Names are compared in normal form
    and inside their scope.
    """
    def node(kind: str, name):
        return F.concat_ws("\x1f", F.lit(kind), F.col("scope"), name)

    asked = wanted.select("scope", "id", F.lit(True).alias("__wanted")).distinct()
    marked = cut_lineage(memories.join(asked, ["scope", "id"], "left"))
    held, kept = marked.where("__wanted"), marked.where("__wanted is null").select(memories.columns)
    named = marked.select("scope", "id", F.explode("entities").alias("n"))
    supports = named.select(node("m", F.col("id").cast("string")).alias("namer"), node("e", norm(F.col("n"))).alias("named"))
    classes = entities.select("scope", "name", F.explode("is_a").alias("n"))
    supports = supports.unionByName(classes.select(node("e", norm(F.col("name"))).alias("namer"), node("e", norm(F.col("n"))).alias("named")))
    gone = cut_lineage(fallen(supports, held.select(node("m", F.col("id").cast("string")).alias("node"))))
    left = entities.withColumn("__node", node("e", norm(F.col("name")))).join(gone.select(F.col("node").alias("__node")), "__node", "left_anti").select(entities.columns)
    return kept, left, held.groupBy("scope").agg(F.count(F.lit(1)).alias("forgotten"))


def erased(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records without the wanted documents; a row of `wanted` without a document erases the whole scope.

    records and wanted: scope, document_id, ...
    """
    scopes = wanted.where("document_id is null").select("scope").distinct()
    documents = wanted.where("document_id is not null").select("scope", "document_id").distinct()
    return records.join(scopes, "scope", "left_anti").join(documents, ["scope", "document_id"], "left_anti").select(records.columns)


def erase_clinical(memories: DataFrame, facts: DataFrame, relations: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, facts) without the wanted patients, documents and guidelines.

    memories: scope, document_id, patient (null for a guideline) and what `patient_facts` reads; facts: what it gave before. Facts are made anew
    for the patients that lost a document and keep others; all others' facts stay untouched.
    """
    kept = cut_lineage(erased(memories, wanted))
    touched = memories.join(wanted.select("scope").distinct(), "scope", "left_semi").where("patient is not null").select("patient").distinct()
    touched = cut_lineage(touched)
    again = patient_facts(kept.where("patient is not null").join(touched, "patient", "left_semi"), relations)
    return kept, facts.join(touched, "patient", "left_anti").unionByName(again.select(facts.columns))
