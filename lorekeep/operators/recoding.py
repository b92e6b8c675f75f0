"""Re-coding: concepts known by their words only take a code when a newer terminology has one, and what hangs on them follows.

Only what changes is touched: memories without such a concept, links of other memories, degrees of other nodes and the closure of known
codes stay as they are. A second run over the result changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import norm
from ..session import cut_lineage, is_empty
from ..sources.taxonomies import IS_A
from .clinical import resolve_terms
from .graph import specificity

FREE = "txt:"
CONCEPT = "array<struct<key:string,term:string,tag:string,was:string>>"


def recodable(memories: DataFrame, terms: DataFrame, concepts: DataFrame, column: str = "concepts") -> DataFrame:
    """(key, term, tag, new_key, new_tag): wordings under a free-text key that the terminology now resolves, each once."""
    free = (memories.select(F.explode(column).alias("c")).where(F.col("c.key").startswith(FREE))
            .select("c.key", "c.term", F.coalesce("c.tag", F.lit("")).alias("tag")).distinct())
    asked = cut_lineage(free.withColumn("mention_id", F.sha2(F.to_json(F.struct("key", "term", "tag")), 256)))
    found = resolve_terms(asked.select("mention_id", "term", "tag"), terms, concepts)
    named = found.join(concepts.select(F.col("id").alias("code"), F.col("tag").alias("new_tag")), "code")
    return asked.join(named, "mention_id").select("key", "term", "tag", F.concat(F.lit("sct:"), "code").alias("new_key"), "new_tag")


def recode(memories: DataFrame, changed: DataFrame, key: str = "memory_id", column: str = "concepts") -> tuple[DataFrame, DataFrame]:
    """(memories, touched): the memories with new keys in `column`, old ones kept as `was`, and the ids of those that changed."""
    changed = cut_lineage(changed.select("key", "term", "tag", "new_key", "new_tag"))
    plain = memories.withColumn(column, F.transform(column, lambda c: F.struct(c["key"].alias("key"), c["term"].alias("term"), c["tag"].alias("tag"),
                                                                               F.lit(None).cast("string").alias("was"))).cast(CONCEPT))
    free = memories.where(F.exists(column, lambda c: c["key"].startswith(FREE)))
    entries = free.select(key, F.posexplode(column).alias("place", "c")).select(key, "place", "c.key", "c.term", "c.tag", F.coalesce("c.tag", F.lit("")).alias("match"))
    renamed = changed.select(F.col("key").alias("k"), F.col("term").alias("t"), F.col("tag").alias("g"), "new_key", "new_tag")
    joined = entries.join(renamed, (F.col("key") == F.col("k")) & F.col("term").eqNullSafe(F.col("t")) & (F.col("match") == F.col("g")), "left")
    entry = F.struct("place", F.coalesce("new_key", "key").alias("key"), "term", F.when(F.col("new_key").isNull(), F.col("tag")).otherwise(F.col("new_tag")).alias("tag"),
                     F.when(F.col("new_key").isNotNull(), F.col("key")).alias("was"))
    remade = joined.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("__new"), F.bool_or(F.col("new_key").isNotNull()).alias("__hit")).where("__hit").drop("__hit")
    remade = cut_lineage(remade.withColumn("__new", F.transform("__new", lambda c: F.struct(c["key"], c["term"], c["tag"], c["was"])).cast(CONCEPT)))
    out = plain.join(remade, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
    return out.select(memories.columns), remade.select(key)


def concept_links(memories: DataFrame, key: str = "memory_id", column: str = "concepts") -> DataFrame:
    """(memory, concept): each concept of a memory once."""
    return memories.select(F.col(key).alias("memory"), F.explode(column).alias("c")).select("memory", F.col("c.key").alias("concept")).distinct()


def relinked(links: DataFrame, memories: DataFrame, touched: DataFrame, key: str = "memory_id", column: str = "concepts") -> tuple[DataFrame, DataFrame]:
    """(links, shift): the links with those of the touched memories made anew, so that links that now name one code are one, and by how
    much the degree of each end changes."""
    ids = touched.select(F.col(key).alias("memory"))
    old = cut_lineage(links.join(ids, "memory", "left_semi"))
    new = cut_lineage(concept_links(memories.join(touched, key, "left_semi"), key, column))
    moves = old.withColumn("n", F.lit(-1)).unionByName(new.withColumn("n", F.lit(1))).groupBy("memory", "concept").agg(F.sum("n").alias("n")).where("n <> 0")
    ends = moves.select(F.col("memory").cast("string").alias("node"), "n").unionByName(moves.select(F.col("concept").alias("node"), "n"))
    shift = ends.groupBy("node").agg(F.sum("n").alias("shift")).where("shift <> 0")
    return links.join(ids, "memory", "left_anti").unionByName(new), cut_lineage(shift)


def shifted_degrees(degrees: DataFrame, shift: DataFrame, fan0: int = 5) -> DataFrame:
    """(node, degree, specificity) after a shift; nodes without links are gone."""
    known = degrees.select("node", "degree").join(shift, "node", "full_outer")
    rows = known.select("node", (F.coalesce("degree", F.lit(0)) + F.coalesce("shift", F.lit(0))).cast("long").alias("degree")).where("degree > 0")
    return rows.withColumn("specificity", specificity(F.col("degree"), fan0))


def extended_closure(closed: DataFrame, relations: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, ancestor): the closure with the codes it lacks. They climb until they meet a code that is closed already, and take its ancestors."""
    up = cut_lineage(relations.where(F.col("type") == IS_A).select(F.col("source").alias("node"), F.col("target").alias("above")).distinct())
    fresh = cut_lineage(codes.select("code").distinct().join(closed.select("code").distinct(), "code", "left_anti"))
    known = closed.select(F.col("code").alias("node"), "ancestor")
    found, frontier = fresh.select("code", F.col("code").alias("ancestor")), fresh.select("code", F.col("code").alias("node"))
    while not is_empty(frontier):
        above = frontier.join(up, "node").select("code", F.col("above").alias("node")).distinct()
        above = cut_lineage(above.join(found.withColumnRenamed("ancestor", "node"), ["code", "node"], "left_anti"))
        stored = above.join(known, "node").select("code", "ancestor")
        found = cut_lineage(found.unionByName(above.select("code", F.col("node").alias("ancestor"))).unionByName(stored).distinct())
        frontier = above.join(known.select("node").distinct(), "node", "left_anti")
    return closed.select("code", "ancestor").unionByName(found)


def free_key(term: Column) -> Column:
    """The key of a wording without a code."""
    return F.concat(F.lit(FREE), norm(term))
