"""Linking extracted concepts: exact lookup, taxonomy candidates, anchors, decision gates, batch resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import stable_id
from ..functions.text import casefold, taxonomy_forms, terms, words
from ..session import cut_lineage
from . import fusion, graph
from .components import connected_components
from .nearest import hybrid_topk, rank_inputs, vector_topk
from .skew import shuffled, top_per_group


def label_keys(concepts: DataFrame, key: str = "id") -> DataFrame:
    """(id, label_key): a concept's label and aliases, case-folded, each once."""
    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts.select(key, F.explode(names).alias("n")).select(key, casefold(F.trim("n")).alias("label_key")).distinct()


def exact_concepts(labels: DataFrame, nodes: DataFrame, authority: str | None = None) -> DataFrame:
    """(label_key, id): the concept a label or alias names exactly, imported ones before local ones, then by id."""
    own = nodes.where(F.col("kind") == "Concept")
    if authority is not None:
        own = own.where(F.col("origin").isin(authority, "LOCAL"))
    keys = label_keys(own).join(own.select("id", F.coalesce("origin", F.lit("LOCAL")).alias("origin")), "id")
    hits = keys.join(labels.select("label_key").distinct(), "label_key", "left_semi")
    return hits.groupBy("label_key").agg(F.min_by("id", F.struct(F.col("origin") == "LOCAL", F.col("id"))).alias("id"))


def rare_forms(queries: DataFrame, frequency: DataFrame, size: Column) -> DataFrame:
    """(query_id, form): a query's words that label few concepts (the rarest when all are common), with their other number."""
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).join(frequency, "term", "left").fillna(0, ["df"])
    limit = F.greatest(F.lit(5.0), size / 200)
    # Windows, not a join with the rarest words: the texts are read and taken apart once.
    own = Window.partitionBy("query_id")
    judged = asked.withColumn("rare", F.col("df") <= limit).withColumns({
        "rarest": F.min_by("term", F.struct("df", "term")).over(own), "any": F.bool_or("rare").over(own)})
    kept = judged.where(F.col("rare") | (~F.col("any") & (F.col("term") == F.col("rarest"))))
    return kept.select("query_id", F.explode(taxonomy_forms(F.col("term"))).alias("form")).distinct()


def lexical_candidates(queries: DataFrame, concepts: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank) by shared rare words, label words counting extra. concepts of one authority."""
    label = F.concat_ws(" ", "label", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    content = F.concat_ws(" ", "routing_summary", "summary", "text")
    labelled = concepts.select("id", F.explode(words(label)).alias("term"))
    # Tables, so that their sizes are known where they are joined.
    frequency = cut_lineage(labelled.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    forms = rare_forms(queries, frequency, concepts.agg(F.count(F.lit(1))).scalar())
    # The wanted list is searched as a query of its own, so stop words among the forms fall away again.
    wanted = forms.groupBy("query_id").agg(F.concat_ws(" ", F.collect_set("form")).alias("text")).select("query_id", terms(F.col("text")).alias("words"))
    wanted = wanted.select("query_id", F.size("words").alias("n"), F.explode("words").alias("term"))
    held = cut_lineage(labelled.withColumn("in_label", F.lit(1)).unionByName(
        concepts.select("id", F.explode(words(content)).alias("term")).withColumn("in_label", F.lit(0)))
        .groupBy("id", "term").agg(F.max("in_label").alias("in_label")))
    # Written once: only words that some concept holds, with the number of all the query's words.
    matched = cut_lineage(wanted.join(held.select("term").distinct(), "term", "left_semi"))
    found, sizes = _found(matched, held, limit), matched.select("query_id", "n").distinct()
    scored = found.join(shuffled(sizes), "query_id").select("query_id", "id", (0.5 * F.col("found") / F.col("n") + 0.1 * F.col("labelled") / F.col("n")).alias("score"))
    return top_per_group(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], limit)


def _found(wanted: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, found, labelled): how many wanted words a concept holds, and in its label, for every concept that can be among a query's best `limit`.

    wanted: query_id, term; held: id, term, in_label, each (id, term) once. Of a query's most frequent word only the best `limit` concepts are taken, label first,
    then by id: any other concept that holds this word alone stands behind all of those, and one that holds another word as well is found by that.
    """
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("many"))
    most_first = Window.partitionBy("query_id").orderBy(F.col("many").desc(), "term")
    matched = wanted.join(frequency, "term").withColumn("place", F.row_number().over(most_first)).select("query_id", "term", "place")
    frequent = matched.where("place = 1").select("query_id", "term")
    # What grows with the concepts or the queries is dealt, however small its file is.
    others = (matched.where("place > 1").join(shuffled(held), "term").groupBy("query_id", "id")
              .agg(F.count(F.lit(1)).alias("found"), F.sum("in_label").alias("labelled")))
    # Concepts found by another word may hold the most frequent one, too.
    whole = others.join(shuffled(frequent), "query_id").join(shuffled(held), ["id", "term"], "left").select(
        "query_id", "id", (F.col("found") + F.col("in_label").isNotNull().cast("int")).alias("found"), (F.col("labelled") + F.coalesce("in_label", F.lit(0))).alias("labelled"))
    first = top_per_group(held, ["term"], [F.col("in_label").desc(), F.col("id")], limit).drop("rank")
    alone = frequent.join(first, "term").select("query_id", "id", F.lit(1).cast("long").alias("found"), F.col("in_label").cast("long").alias("labelled"))
    return whole.unionByName(alone).groupBy("query_id", "id").agg(F.max("found").alias("found"), F.max("labelled").alias("labelled"))


def taxonomy_candidates(queries: DataFrame, concepts: DataFrame, limit: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank): semantic and lexical candidates interleaved. vectors: (id, vec); queries carry vec then."""
    lexical = lexical_candidates(queries, concepts, limit)
    if vectors is None:
        return fusion.interleave([lexical], limit, "query_id", "id")
    semantic = vector_topk(vectors.join(concepts.select("id"), "id", "left_semi"), queries.select("query_id", "vec"), limit, "id")
    return fusion.interleave([semantic, lexical], limit, "query_id", "id")


def anchors(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, authority: str) -> DataFrame:
    """(concept, anchor): an official concept anchors itself, a local one its official ancestors and its stored anchors."""
    own = concepts.join(nodes.select(F.col("id").alias("concept"), "origin", "anchor_ids"), "concept")
    official = own.where(F.col("origin") == authority).select("concept", F.col("concept").alias("anchor"))
    local = own.where(F.coalesce("origin", F.lit("LOCAL")) == "LOCAL")
    above = graph.taxonomy_ancestors(nodes, edges, local.select("concept"), authority).select("concept", F.col("ancestor").alias("anchor"))
    stored = local.select("concept", F.explode("anchor_ids").alias("anchor")).join(
        nodes.where(F.col("origin") == authority).select(F.col("id").alias("anchor")), "anchor", "left_semi").select("concept", "anchor")
    return official.unionByName(above).unionByName(stored).distinct()


def judge_decisions(decisions: DataFrame, candidates: DataFrame, anchored: DataFrame, threshold: float = 0.75, provisional: float = 0.5) -> DataFrame:
    """Adds `outcome` (accepted, provisional, skipped) and `reason` to classification decisions.

    decisions: spec_id, reuse_id, parent_ids, confidence; candidates: spec_id, id; anchored: ids that have an anchor.
    """
    known = candidates.select("spec_id", F.col("id").alias("ref")).distinct().withColumn("__known", F.lit(True))
    sound = anchored.select(F.col("id").alias("ref")).distinct().withColumn("__anchored", F.lit(True))
    refs = decisions.select("spec_id", F.explode(F.array_compact(F.concat(F.array("reuse_id"), F.coalesce("parent_ids", F.array().cast("array<string>"))))).alias("ref"))
    flags = refs.join(known, ["spec_id", "ref"], "left").join(sound, "ref", "left").fillna(False, ["__known", "__anchored"])
    per_spec = flags.groupBy("spec_id").agg(F.bool_and("__known").alias("known"), F.bool_or("__anchored").alias("anchored"))
    rows = decisions.join(per_spec, "spec_id", "left")
    low = F.col("confidence") < threshold
    floor = min(provisional, threshold)
    reason = (F.when((F.col("confidence") < floor) | (low & F.col("reuse_id").isNotNull()), F.lit("low_confidence"))
              .when(F.col("reuse_id").isNotNull() & ~F.col("known"), F.lit("unknown_reuse_id"))
              .when(F.col("reuse_id").isNotNull() & ~F.col("anchored"), F.lit("unanchored_reuse"))
              .when(F.col("reuse_id").isNotNull(), F.lit(None).cast("string"))
              .when(F.size(F.coalesce("parent_ids", F.array().cast("array<string>"))) == 0, F.lit("no_parent"))
              .when(~F.col("known"), F.lit("unknown_parent_id"))
              .when(~F.col("anchored"), F.lit("no_anchor")))
    return rows.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNotNull(), F.lit("skipped")).when(
        low, F.lit("provisional")).otherwise(F.lit("accepted"))).drop("known", "anchored")


def resolve_batch(specs: DataFrame, stored: DataFrame, prefix: str = "lorekeep") -> DataFrame:
    """(spec_id, concept_id, is_new): specs that share a label or alias with each other or a stored concept are one.

    A set that touches a stored concept takes its id (official before local), else the id of its smallest label.
    """
    spec_keys = label_keys(specs.withColumnRenamed("spec_id", "id")).withColumnRenamed("id", "spec_id")
    exact = exact_concepts(spec_keys, stored.withColumn("kind", F.lit("Concept"))).join(
        stored.select("id", (F.coalesce("origin", F.lit("LOCAL")) == "LOCAL").alias("local")), "id")
    # The marks keep spec ids and labels apart; both are read back without them, whatever their length.
    nodes = spec_keys.select(F.concat(F.lit("s:"), F.col("spec_id").cast("string")).alias("id"), F.concat(F.lit("k:"), "label_key").alias("k"))
    bare = F.substring("id", F.lit(3), F.length("id"))
    sets = connected_components(nodes.select("id").unionByName(nodes.select(F.col("k").alias("id"))), nodes.select(F.col("id").alias("a"), F.col("k").alias("b")))
    named = spec_keys.join(exact, "label_key", "left").join(
        sets.where(F.col("id").startswith("k:")).select(bare.alias("label_key"), "component"), "label_key")
    chosen = named.groupBy("component").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("local", "id"))).alias("known"), F.min("label_key").alias("first"))
    ids = chosen.select("component", F.coalesce("known.id", stable_id("concept", F.col("first"), prefix)).alias("concept_id"), F.col("known").isNull().alias("is_new"))
    own = sets.where(F.col("id").startswith("s:")).select(bare.alias("spec_id"), "component")
    return own.join(ids, "component").select("spec_id", "concept_id", "is_new")


def fuzzy_candidates(specs: DataFrame, stored: DataFrame, limit: int = 8, threshold: float = 0.2) -> DataFrame:
    """(spec_id, id, score, rank): the concepts whose hybrid score with a spec's label and description reaches the threshold, the best `limit`.

    specs: spec_id, label, description, vec; stored: id, label, aliases, routing_summary, summary, text, embedding, hits. Blocks of specs meet blocks of
    concepts; a vector alone can carry a pair over the threshold, so shared words prune what travels (words no spec asks for), not which blocks meet.
    """
    asked = specs.select(F.col("spec_id").alias("query_id"), F.concat_ws(" ", "label", "description").alias("text"), "vec")
    found = hybrid_topk(rank_inputs(stored.withColumnRenamed("id", "node_id")), asked, limit)
    return found.where(F.col("score") >= threshold).select(F.col("query_id").alias("spec_id"), F.col("node_id").alias("id"), "score", "rank")


def resolve_with_candidates(specs: DataFrame, stored: DataFrame, decide=None, limit: int = 8, threshold: float = 0.2, prefix: str = "lorekeep") -> DataFrame:
    """(spec_id, concept_id, is_new, score): `resolve_batch`, and what it calls new takes a near concept's id where there is one.

    One spec of each new set, the smallest by id, asks for candidates, so wordings that many specs share are compared once. `decide` picks (spec_id, id, score)
    from the candidates, at most one each; by default the best. `score` is that of the candidate taken, else null.
    """
    resolved = cut_lineage(resolve_batch(specs.select("spec_id", "label", "aliases"), stored, prefix))
    leads = resolved.where("is_new").groupBy("concept_id").agg(F.min("spec_id").alias("spec_id"))
    candidates = cut_lineage(fuzzy_candidates(specs.join(leads.select("spec_id"), "spec_id", "left_semi"), stored, limit, threshold))
    taken = (decide or (lambda c: c.where("rank = 1")))(candidates).select("spec_id", F.col("id").alias("near"), "score")
    reused = leads.join(taken, "spec_id").select("concept_id", "near", "score")
    out = resolved.join(reused, "concept_id", "left")
    return out.select("spec_id", F.coalesce("near", "concept_id").alias("concept_id"), (F.col("is_new") & F.col("near").isNull()).alias("is_new"), "score")


def link_documents(extracted: DataFrame, resolved: DataFrame, anchored: DataFrame) -> DataFrame:
    """ABOUT edges from every node that extracted a concept to the concept and its anchors.

    extracted: document_id, node_id, label; resolved: document_id, label_key, concept_id; anchored: concept, anchor.
    """
    keyed = extracted.select("document_id", "node_id", casefold(F.col("label")).alias("label_key")).distinct()
    direct = keyed.join(resolved, ["document_id", "label_key"]).select("node_id", "concept_id")
    above = direct.join(anchored.select(F.col("concept").alias("concept_id"), "anchor"), "concept_id").select("node_id", F.col("anchor").alias("concept_id"))
    return direct.unionByName(above).distinct().select(F.col("node_id").alias("src"), F.col("concept_id").alias("dst"), F.lit("ABOUT").alias("relation"))


def distinct_specs(specs: DataFrame) -> DataFrame:
    """The first spec of each label in a document. specs carry document_id, place, label."""
    keyed = specs.withColumn("label_key", casefold(F.col("label")))
    first = keyed.groupBy("document_id", "label_key").agg(F.min("place").alias("place"))
    return keyed.join(first, ["document_id", "label_key", "place"])


def drop_failed_parents(specs: DataFrame, failed: DataFrame) -> DataFrame:
    """Specs whose broader labels no longer name a concept that failed in the same document."""
    rows = specs.withColumn("__b", F.explode_outer("broader")).withColumn("__k", casefold(F.col("__b")))
    lost = failed.select("document_id", F.col("label_key").alias("__k")).distinct().withColumn("__lost", F.lit(True))
    kept = rows.join(lost, ["document_id", "__k"], "left").where(F.col("__lost").isNull() & F.col("__b").isNotNull())
    broader = kept.groupBy("document_id", "label").agg(F.sort_array(F.collect_set("__b")).alias("broader"))
    return specs.drop("broader").join(broader, ["document_id", "label"], "left").withColumn("broader", F.coalesce("broader", F.array().cast("array<string>")))


def review(decided: DataFrame) -> DataFrame:
    """Skips by reason and provisional concepts per document."""
    return decided.groupBy("document_id", F.coalesce("reason", "outcome").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def alignments(rows: DataFrame, prefix: str = "lorekeep") -> DataFrame:
    """EXACT_MATCH or CLOSE_MATCH edges to concepts of external systems."""
    target = stable_id("external-concept", F.concat("system", F.lit(":"), "external_id"), prefix)
    return rows.select(F.col("concept_id").alias("src"), target.alias("dst"), F.when(F.col("exact"), F.lit("EXACT_MATCH")).otherwise(F.lit("CLOSE_MATCH")).alias("relation"))
