"""Taxonomy imports as tables: SKOS triples, SNOMED CT RF2 snapshots, normalised JSON, terminology tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import edge_id, stable_id
from ..functions.text import norm
from ..operators.graph import closure

# Public vocabulary addresses.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_VALUE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#value"
SKOS = "http://www.w3.org/2004/02/skos/core#"
ISO_THES = "http://purl.org/iso25964/skos-thes#"
NOTES = ["definition", "scopeNote", "note", "historyNote", "editorialNote", "changeNote"]

# SNOMED CT identifiers.
IS_A, PREFERRED, FULL_NAME, ROOT_CODE = "116680003", "900000000000548007", "900000000000003001", "138875005"
SNOMED_URI = "http://snomed.info/id/"

TRIPLES = "s string, p string, o string, o_is_uri boolean, lang string, datatype string"


def preferred(values: Column, language: str) -> Column:
    """The first label in the display language, else English, French, or the first language there is."""
    def first(lang):
        return F.element_at(F.element_at(values, lang), 1)
    any_language = F.element_at(F.element_at(values, F.element_at(F.array_sort(F.map_keys(values)), 1)), 1)
    return F.coalesce(first(F.lit(language)), first(F.lit("en")), first(F.lit("fr")), F.when(F.size(values) > 0, any_language), F.lit(""))


def _by_language(rows: DataFrame, name: str) -> DataFrame:
    """(s, map language -> sorted values). Repeats fall together before they move."""
    lists = rows.distinct().groupBy("s", "lang").agg(F.sort_array(F.collect_list("o")).alias("v"))
    return lists.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "v")))).alias(name))


def skos_nodes(triples: DataFrame, authority: str, language: str = "fr", prefix: str = "lorekeep") -> DataFrame:
    """Concept and group rows with labels by language, notes, aliases and a display label."""
    if not authority.strip() or authority == "LOCAL":
        raise ValueError("an imported taxonomy needs a named authority other than LOCAL")
    types = triples.where(F.col("p") == RDF_TYPE)
    concept = types.where(F.col("o") == SKOS + "Concept").select("s").distinct().withColumn("kind", F.lit("Concept"))
    group = types.where(F.col("o") == SKOS + "Collection").select("s").distinct().join(concept, "s", "left_anti").withColumn("kind", F.lit("TaxonomyGroup"))
    role = types.groupBy("s").agg(F.max(F.when(F.col("o").endswith("#Domain"), 2).when(F.col("o").endswith("#MicroThesaurus"), 1).otherwise(0)).alias("role"))
    subjects = concept.unionByName(group)
    literal = triples.where(~F.col("o_is_uri")).select("s", "p", F.coalesce("lang", F.lit("und")).alias("lang"), "o")
    out = subjects.join(role, "s", "left")
    for name, label in (("pref_labels", "prefLabel"), ("alt_labels", "altLabel"), ("hidden_labels", "hiddenLabel")):
        out = out.join(_by_language(literal.where(F.col("p") == SKOS + label).select("s", "lang", "o"), name), "s", "left")
    # A note may point to a resource that carries its text.
    notes = triples.where(F.col("p").isin([SKOS + n for n in NOTES]))
    direct = notes.where(~F.col("o_is_uri")).select("s", F.coalesce("lang", F.lit("und")).alias("lang"), "o")
    through = notes.where("o_is_uri").select("s", F.col("o").alias("r")).join(
        literal.where(F.col("p") == RDF_VALUE).select(F.col("s").alias("r"), "lang", "o"), "r").select("s", "lang", "o")
    out = out.join(_by_language(direct.unionByName(through), "descriptions"), "s", "left")
    top = triples.where(F.col("p") == SKOS + "topConceptOf").select("s").distinct().withColumn("is_top_concept", F.lit(True))
    label = preferred(F.coalesce("pref_labels", F.create_map().cast("map<string,array<string>>")), language)
    everything = F.flatten(F.concat(*[F.coalesce(F.map_values(c), F.array().cast("array<array<string>>")) for c in ("pref_labels", "alt_labels", "hidden_labels")]))
    described = preferred(F.coalesce("descriptions", F.create_map().cast("map<string,array<string>>")), language)
    rows = out.join(top, "s", "left").withColumn("label", label).withColumn("description", described)
    return rows.select(
        stable_id("ontology:" + authority, F.col("s"), prefix).alias("id"), "kind", F.col("s").alias("uri"), F.lit(authority).alias("origin"),
        F.element_at(F.split("s", "/"), -1).alias("external_id"), "label",
        F.array_sort(F.array_except(F.array_distinct(everything), F.array("label"))).alias("aliases"),
        "pref_labels", "alt_labels", "hidden_labels", "descriptions", "description", F.coalesce("is_top_concept", F.lit(False)).alias("is_top_concept"),
        F.when(F.col("kind") == "TaxonomyGroup", F.when(F.col("role") == 2, F.lit("domain")).when(F.col("role") == 1, F.lit("microthesaurus")).otherwise(F.lit("collection"))).alias("group_type"),
        F.concat(F.lit(authority + ": "), "label", F.lit(". "), "description").alias("routing_summary"))


def skos_links(triples: DataFrame, nodes: DataFrame, authority: str, prefix: str = "lorekeep") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, dangling triples, self-related subjects). Inverse and symmetric statements become one edge that keeps them all."""
    relation = {SKOS + "broader": "BROADER_THAN", SKOS + "narrower": "BROADER_THAN", SKOS + "related": "RELATED_TO", SKOS + "member": "HAS_MEMBER",
                ISO_THES + "subGroup": "HAS_MEMBER", ISO_THES + "superGroup": "HAS_MEMBER"}
    known = nodes.select("uri")
    stated = triples.where(F.col("p").isin(list(relation))).join(known.withColumnRenamed("uri", "s"), "s", "left_semi")
    dangling = stated.join(known.withColumnRenamed("uri", "o"), "o", "left_anti")
    table = F.create_map(*[F.lit(x) for pair in relation.items() for x in pair])
    inverse = F.col("p").isin(SKOS + "broader", ISO_THES + "superGroup")
    related = F.col("p") == SKOS + "related"
    start = F.when(related, F.least("s", "o")).when(inverse, F.col("o")).otherwise(F.col("s"))
    end = F.when(related, F.greatest("s", "o")).when(inverse, F.col("s")).otherwise(F.col("o"))
    def ident(c):
        return stable_id("ontology:" + authority, c, prefix)
    rows = stated.select(ident(start).alias("src"), ident(end).alias("dst"), F.element_at(table, F.col("p")).alias("relation"), "s", "p", "o").distinct()
    edges = rows.groupBy("src", "dst", "relation").agg(F.sort_array(F.collect_list(F.struct("s", "p", "o"))).alias("statements")).withColumn(
        "edge_id", edge_id(F.col("src"), F.col("relation"), F.col("dst"), prefix=prefix)).withColumn("authority", F.lit(authority))
    return edges, dangling, stated.where(related & (F.col("s") == F.col("o"))).select("s").distinct()


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a digest of the snapshot's content that does not depend on row order, and its counts.

    Row digests are summed in fixed-width halves, so nothing is sorted or gathered.
    """
    def halves(rows):
        text = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
        parts = [F.sum(F.conv(F.substring(text, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
        return rows.agg(*parts, F.count(F.lit(1)).alias("n"))
    both = halves(nodes).select(F.lit("nodes").alias("part"), "*").unionByName(halves(edges).select(F.lit("edges").alias("part"), "*"))
    return both.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", "n", "h0", "h1", "h2", "h3"))), "|"), 256).alias("fingerprint"))


def manifest(nodes: DataFrame, edges: DataFrame, authority: str) -> DataFrame:
    """(authority, fingerprint, relation counts) of a snapshot."""
    counts = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "n")))).alias("relations"))
    return fingerprint(nodes, edges).select(F.lit(authority).alias("authority"), "fingerprint", counts.scalar().alias("relations"),
                                            nodes.agg(F.count_if(F.col("kind") == "Concept")).scalar().alias("concepts"),
                                            nodes.agg(F.count_if(F.col("kind") == "TaxonomyGroup")).scalar().alias("groups"))


def import_state(stored: DataFrame, current: DataFrame) -> str:
    """new, same or differs: a snapshot may be imported once; another content needs an explicit migration."""
    row = current.join(stored.select("authority", F.col("fingerprint").alias("before")), "authority", "left").select("fingerprint", "before").first()
    return "new" if row["before"] is None else "same" if row["before"] == row["fingerprint"] else "differs"


def read_normalized(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the JSON interchange form, one object per line with `nodes` and `edges` files."""
    return spark.read.schema(nodes_schema).json(f"{path}/nodes"), spark.read.schema(edges_schema).json(f"{path}/edges")


# --- RF2 ---
RF2_SCHEMAS = {  # fixed values: columns of the release files, all text
    "concept": "id string, effectiveTime string, active string, moduleId string, definitionStatusId string",
    "description": "id string, effectiveTime string, active string, moduleId string, conceptId string, languageCode string, typeId string, term string, caseSignificanceId string",
    "language": "id string, effectiveTime string, active string, moduleId string, refsetId string, referencedComponentId string, acceptabilityId string",
    "relationship": "id string, effectiveTime string, active string, moduleId string, sourceId string, destinationId string, relationshipGroup string, typeId string, characteristicTypeId string, modifierId string",
}


def read_rf2(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Active rows of one RF2 snapshot file: tab-separated, no quoting."""
    rows = spark.read.schema(RF2_SCHEMAS[table]).option("sep", "\t").option("quote", "").option("header", True).csv(path)
    return rows.where(F.col("active") == "1")


def rf2_problems(concepts: DataFrame, descriptions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships with unknown ends and concepts without a description: (problem, id)."""
    ids = concepts.select("id")
    lost = (relationships.join(ids.withColumnRenamed("id", "sourceId"), "sourceId", "left_anti").select("id")
            .unionByName(relationships.join(ids.withColumnRenamed("id", "destinationId"), "destinationId", "left_anti").select("id")).distinct())
    bare = ids.join(descriptions.select(F.col("conceptId").alias("id")), "id", "left_anti")
    return lost.select(F.lit("dangling").alias("problem"), "id").unionByName(bare.select(F.lit("no_description").alias("problem"), "id"))


def rf2_nodes(concepts: DataFrame, descriptions: DataFrame, language_refset: DataFrame, authority: str, language: str = "fr", prefix: str = "lorekeep") -> DataFrame:
    """Concept rows: per language the preferred terms, else the full names, else the first term; all terms as aliases."""
    chosen = language_refset.where(F.col("acceptabilityId") == PREFERRED).select(F.col("referencedComponentId").alias("id")).distinct().withColumn("__p", F.lit(True))
    rows = descriptions.join(chosen, "id", "left").select(F.col("conceptId").alias("code"), F.col("languageCode").alias("lang"), "term",
                                                          (F.col("typeId") == FULL_NAME).alias("full"), F.coalesce("__p", F.lit(False)).alias("pref"))
    per = rows.groupBy("code", "lang").agg(
        F.sort_array(F.collect_list("term")).alias("terms"), F.sort_array(F.collect_list(F.when(F.col("full"), F.col("term")))).alias("names"),
        F.sort_array(F.collect_list(F.when(~F.col("full") & F.col("pref"), F.col("term")))).alias("best"))
    shown = F.when(F.size("best") > 0, F.col("best")).when(F.size("names") > 0, F.col("names")).otherwise(F.slice("terms", 1, 1))
    def entries(c):
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", c))))
    maps = per.withColumn("shown", shown).groupBy("code").agg(entries(F.col("shown")).alias("pref_labels"), entries(F.col("terms")).alias("alt_labels"),
                                                              entries(F.col("names")).alias("descriptions"), F.flatten(F.collect_list("terms")).alias("__all"))
    def first(lang):
        return F.element_at(F.element_at("pref_labels", F.lit(lang)), 1)
    any_language = F.element_at(F.element_at(F.map_values("pref_labels"), 1), 1)
    rows = concepts.select(F.col("id").alias("code")).join(maps, "code").withColumn("label", F.coalesce(first(language), first("en"), any_language))
    uri = F.concat(F.lit(SNOMED_URI), "code")
    return rows.select(stable_id("ontology:" + authority, uri, prefix).alias("id"), F.lit("Concept").alias("kind"), uri.alias("uri"), F.lit(authority).alias("origin"),
                       F.col("code").alias("external_id"), "label", F.array_sort(F.array_except(F.array_distinct("__all"), F.array("label"))).alias("aliases"),
                       "pref_labels", "alt_labels", "descriptions", F.concat(F.lit(authority + ": "), "label").alias("routing_summary"))


def rf2_edges(relationships: DataFrame, authority: str, prefix: str = "lorekeep") -> DataFrame:
    """is-a rows become parent → child BROADER_THAN, every other type a SEMANTIC_RELATION with its predicate and row."""
    broader = F.col("typeId") == IS_A
    def ident(c):
        return stable_id("ontology:" + authority, F.concat(F.lit(SNOMED_URI), c), prefix)
    src = F.when(broader, F.col("destinationId")).otherwise(F.col("sourceId"))
    dst = F.when(broader, F.col("sourceId")).otherwise(F.col("destinationId"))
    rows = relationships.select(ident(src).alias("src"), ident(dst).alias("dst"), F.when(broader, F.lit("BROADER_THAN")).otherwise(F.lit("SEMANTIC_RELATION")).alias("relation"),
                                F.concat(F.lit(SNOMED_URI), "typeId").alias("predicate"), F.col("id").alias("row_id"), F.lit(authority).alias("authority"))
    return rows.withColumn("edge_id", edge_id(F.col("src"), F.col("relation"), F.col("dst"), F.col("predicate"), F.col("row_id"), prefix)).dropDuplicates(["edge_id"])


TAG_PATTERN = r"\s*\(([^()]*)\)$"  # fixed value: the semantic tag at the end of a full name


def semantic_tag(name: Column) -> Column:
    return F.regexp_extract(name, TAG_PATTERN, 1)


def without_tag(name: Column) -> Column:
    return F.regexp_replace(name, TAG_PATTERN, "")


def terminology(concepts: DataFrame, descriptions: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concept, term, relation): English-first names with tag and depth, normalised terms, relationships by code."""
    active = descriptions.join(concepts.select(F.col("id").alias("conceptId")), "conceptId", "left_semi")
    full = F.col("typeId") == FULL_NAME
    names = active.where(full).groupBy(F.col("conceptId").alias("id")).agg(F.min_by("term", F.struct(F.col("languageCode") != "en", F.col("languageCode"), F.col("term"))).alias("fsn"))
    text = F.when(full, without_tag(F.col("term"))).otherwise(F.col("term"))
    term = active.select(F.col("conceptId").alias("concept"), F.col("languageCode").alias("lang"), full.cast("int").alias("fsn"), text.alias("term")).withColumn("norm", norm(F.col("term")))
    relation = relationships.select(F.col("sourceId").alias("source"), F.col("typeId").alias("type"), F.col("destinationId").alias("target"))
    down = relation.where(F.col("type") == IS_A).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    root = concepts.sparkSession.range(1).select(F.lit(ROOT_CODE).alias("start"), F.lit(ROOT_CODE).alias("node"))
    depth = closure(root, down).select(F.col("node").alias("id"), "depth")
    concept = names.join(depth, "id", "left").select("id", "fsn", semantic_tag(F.col("fsn")).alias("tag"), F.coalesce("depth", F.lit(99)).alias("depth"))
    return concept, term, relation
