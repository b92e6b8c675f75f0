"""From questions to packed, citable evidence: explore, order, budget, view, coverage, graph of the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import token_count, truncate_tokens
from ..functions.vectors import hash_embedding
from ..operators import concepts, context, exploration, inference
from .registry import query
from .search import embedded


def answer_context(needs: DataFrame, questions: DataFrame, nodes: DataFrame, edges: DataFrame, provenance: DataFrame, budget: int = 6000,
                   params: exploration.ExploreParams | None = None, by_source: bool = False, **hooks) -> dict[str, DataFrame]:
    """Evidence, branches and the packed context of each question."""
    found = exploration.explore(needs, questions, nodes, edges, provenance, params, **hooks)
    evidence = exploration.with_contradictions(found["evidence"], edges, nodes)
    placed = context.grouped_by_source(evidence) if by_source else context.grouped_by_need(evidence, needs.select("query_id", "need_id", "need_no"))
    order = context.context_order(placed)
    sized = (order.join(evidence.select("query_id", "evidence_id", "node_id", "document_id", "text", "relevance", "contradicts"), ["query_id", "evidence_id"])
             .withColumn("text_tokens", token_count(F.col("text"))).withColumn("overhead", context.view_tokens("evidence_id", "document_id", "contradicts")))
    packed = context.pack_context(sized, budget).join(sized.drop("place"), ["query_id", "evidence_id"])
    # What the model reads: an item that did not fit whole holds no more than the tokens kept of it.
    return {**found, "context": packed.withColumn("text", F.when(F.col("truncated"), truncate_tokens(F.col("text"), F.col("kept_tokens").cast("int"))).otherwise(F.col("text")))}


def document_graph(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, provenance): documents provided by sources, about one concept per language."""
    docs = t.documents
    node = F.concat(F.lit("d:"), F.col("doc_id").cast("string"))
    empty = F.array().cast("array<string>")
    documents = docs.select(node.alias("id"), F.lit("Document").alias("kind"), F.col("source").alias("label"), empty.alias("aliases"), "text", F.lit("").alias("summary"),
                            F.lit("").alias("routing_summary"), hash_embedding(F.col("text")).alias("embedding"), F.lit(0).alias("hits"), F.lit(True).alias("retrieval_leaf"))
    languages = docs.select("lang").distinct().select(
        F.concat(F.lit("k:"), "lang").alias("id"), F.lit("Concept").alias("kind"), F.col("lang").alias("label"), empty.alias("aliases"), F.lit("").alias("text"), F.lit("").alias("summary"),
        F.concat(F.lit("documents in "), "lang").alias("routing_summary"), hash_embedding(F.col("lang")).alias("embedding"), F.lit(0).alias("hits"), F.lit(False).alias("retrieval_leaf"))
    edges = docs.select(F.concat(F.lit("s:"), "source").alias("src"), node.alias("dst"), F.lit("PROVIDES").alias("relation")).unionByName(
        docs.select(node.alias("src"), F.concat(F.lit("k:"), "lang").alias("dst"), F.lit("ABOUT").alias("relation")))
    return documents.unionByName(languages), edges, docs.select(node.alias("node_id"), node.alias("document_id"))


def question_needs(t) -> tuple[DataFrame, DataFrame]:
    questions = embedded(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))
    needs = inference.question_as_need(questions).withColumn("vec", hash_embedding(F.col("description")))
    return questions, needs


@query("answer_context")
def _context(t):
    questions, needs = question_needs(t)
    nodes, edges, provenance = document_graph(t)
    packed = answer_context(needs, questions, nodes, edges, provenance, 2000)["context"]
    return packed.select("query_id", "evidence_id", "node_id", "place", "kept_tokens", "truncated", token_count(F.col("text")).alias("tokens"))


@query("exploration_branches")
def _branches(t):
    questions, needs = question_needs(t)
    nodes, edges, provenance = document_graph(t)
    found = exploration.explore(needs, questions, nodes, edges, provenance)["branches"]
    return found.select("query_id", "need_key", "node_id", "parent_id", "depth", F.round("score", 6).alias("score"), "action", "outcome")


@query("model_view", """WITH d AS (SELECT source || '-' || doc_id // 10 AS query_id, doc_id, lang, row_number() OVER (PARTITION BY source, doc_id // 10 ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT d.query_id, 'e' || d.doc_id AS evidence_id, 'E' || d.place AS alias, 'doc ' || d.doc_id AS title, d.lang AS section,
  concat_ws(',', 'E' || p.place, 'E' || n.place) AS contradicts FROM d LEFT JOIN d p ON p.query_id = d.query_id AND p.doc_id = d.doc_id - 2 LEFT JOIN d n ON n.query_id = d.query_id AND n.doc_id = d.doc_id + 1""")
def _view(t):
    """Every document in a context of at most ten of its source, longest first; it contradicts the one two before and the next one, where they are in the context."""
    none = F.lit(None).cast("string")
    doc = F.col("doc_id").cast("string")
    context_id = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 10).cast("string"))
    others = F.transform(F.array(F.lit(-2), F.lit(1)), lambda step: (F.col("doc_id") + step).cast("string"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "doc_id"))
    rows = t.documents.withColumn("query_id", context_id).withColumn("place", place).select(
        "query_id", F.concat(F.lit("e"), doc).alias("evidence_id"), doc.alias("node_id"), "place", "text", F.concat(F.lit("doc "), doc).alias("title"), none.alias("uri"),
        none.alias("author"), none.alias("published_at"), none.alias("retrieved_at"), F.array("lang").alias("section_path"), others.alias("contradictions"))
    view = context.model_view(rows)
    return view.select("query_id", "evidence_id", "alias", F.col("source.title").alias("title"), F.col("source.section").alias("section"), F.array_join("contradicts", ",").alias("contradicts"))


@query("concept_lookup", """WITH k AS (SELECT p_partkey AS id, lower(p_name) AS label_key, p_size <= 10 AS imported FROM part UNION SELECT p_partkey, lower(p_brand), p_size <= 10 FROM part)
SELECT label_key, arg_min(id, (NOT imported, id)) AS id FROM k WHERE label_key IN (SELECT DISTINCT lower(p_name) FROM part UNION SELECT DISTINCT lower(p_type) FROM part) GROUP BY label_key""")
def _lookup(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.lit("Concept").alias("kind"), F.col("p_name").alias("label"), F.array("p_brand").alias("aliases"),
                          F.when(F.col("p_size") <= 10, F.lit("MAIN")).otherwise(F.lit("LOCAL")).alias("origin"))
    labels = t.part.select(F.explode(F.array("p_name", "p_type")).alias("n")).select(F.lower("n").alias("label_key"))
    return concepts.exact_concepts(labels, nodes, "MAIN")


@query("concept_decisions", """WITH d AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_quantity::INT AS spec, l_partkey, l_suppkey, l_linenumber, l_discount * 10 AS confidence, l_returnflag FROM lineitem),
u AS (SELECT l_returnflag AS f, CASE WHEN l_returnflag = 'R' THEN true ELSE false END AS reuse, confidence, l_suppkey % 4 <> 0 AS known, l_partkey % 3 <> 0 AS anchored, l_linenumber = 1 AS noparent FROM d),
r AS (SELECT CASE WHEN confidence < 0.5 OR (confidence < 0.75 AND reuse) THEN 'low_confidence' WHEN reuse AND NOT known THEN 'unknown_reuse_id' WHEN reuse AND NOT anchored THEN 'unanchored_reuse' WHEN reuse THEN NULL
  WHEN noparent THEN 'no_parent' WHEN NOT known THEN 'unknown_parent_id' WHEN NOT anchored THEN 'no_anchor' END AS reason, confidence < 0.75 AS low FROM u)
SELECT CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN low THEN 'provisional' ELSE 'accepted' END AS outcome, reason, count(*) AS n FROM r GROUP BY ALL""")
def _decisions(t):
    spec = F.concat_ws("-", *[F.col(c).cast("string") for c in t.lineitem.columns])
    part = F.col("l_partkey").cast("string")
    reuse = F.col("l_returnflag") == "R"
    rows = t.lineitem.select(spec.alias("spec_id"), F.when(reuse, part).alias("reuse_id"),
                             F.when(reuse | (F.col("l_linenumber") == 1), F.array().cast("array<string>")).otherwise(F.array(part)).alias("parent_ids"),
                             (F.col("l_discount") * 10).alias("confidence"), "l_suppkey", "l_partkey")
    shown = rows.where("l_suppkey % 4 <> 0").select("spec_id", F.col("l_partkey").cast("string").alias("id"))
    anchored = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("id"))
    judged = concepts.judge_decisions(rows.drop("l_suppkey", "l_partkey"), shown, anchored)
    return judged.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("taxonomy_candidates")
def _taxonomy(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.array("p_brand", "p_type").alias("aliases"),
                          F.lit("").alias("routing_summary"), F.lit("").alias("summary"), F.lit("").alias("text"))
    # Invented prose names no part, so a few of their words follow each whole text.
    queries = t.documents.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "text", F.lit("widgets ring"), "source", F.lit("economy")).alias("text"))
    return concepts.taxonomy_candidates(queries, nodes, 5)


@query("concept_resolution", """WITH s AS (SELECT lower(p_name) AS k, min('k' || p_partkey) AS stored FROM part WHERE p_size <= 10 GROUP BY 1)
SELECT p_partkey::VARCHAR AS spec_id, min(p_partkey) OVER (PARTITION BY p_name) AS first_part, stored IS NULL AS is_new, stored FROM part LEFT JOIN s ON k = lower(p_name)""")
def _resolution(t):
    specs = t.part.select(F.col("p_partkey").cast("string").alias("spec_id"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("aliases"))
    stored = t.part.where("p_size <= 10").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"),
                                                 F.array().cast("array<string>").alias("aliases"), F.lit("MAIN").alias("origin"))
    found = concepts.resolve_batch(specs, stored)
    first = found.groupBy("concept_id").agg(F.min(F.col("spec_id").cast("long")).alias("first_part"))
    return found.join(first, "concept_id").select("spec_id", "first_part", "is_new", F.when(~F.col("is_new"), F.col("concept_id")).alias("stored"))
