"""Taxonomy and clinical jobs on tables derived from the shared ones: places and parts as concepts, orders as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clinical, spreading
from ..session import cut_lineage
from ..sources import fhir, taxonomies
from .registry import query


def place_triples(t) -> DataFrame:
    """Regions, nations and customers as a thesaurus: triples with labels, broader and narrower links, one group."""
    base = "http://example.org/place/"
    def uri(prefix, column):
        return F.concat(F.lit(base + prefix), F.col(column).cast("string"))
    none = F.lit(None).cast("string")
    def triple(s, p, o, is_uri, lang=none):
        return [s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(is_uri).alias("o_is_uri"), lang.alias("lang"), none.alias("datatype")]
    skos = taxonomies.SKOS
    region, nation, customer = uri("r", "r_regionkey"), uri("n", "n_nationkey"), uri("c", "c_custkey")
    parts = [
        t.region.select(*triple(region, taxonomies.RDF_TYPE, F.lit(skos + "Concept"), True)), t.region.select(*triple(region, skos + "prefLabel", F.col("r_name"), False, F.lit("en"))),
        t.nation.select(*triple(nation, taxonomies.RDF_TYPE, F.lit(skos + "Concept"), True)), t.nation.select(*triple(nation, skos + "prefLabel", F.col("n_name"), False, F.lit("fr"))),
        t.nation.select(*triple(nation, skos + "broader", uri("r", "n_regionkey"), True)), t.nation.select(*triple(uri("r", "n_regionkey"), skos + "narrower", nation, True)),
        t.customer.select(*triple(customer, taxonomies.RDF_TYPE, F.lit(skos + "Concept"), True)), t.customer.select(*triple(customer, skos + "prefLabel", F.col("c_name"), False, F.lit("en"))),
        t.customer.select(*triple(customer, skos + "altLabel", F.col("c_mktsegment"), False)), t.customer.select(*triple(customer, skos + "scopeNote", F.col("c_mktsegment"), False, F.lit("en"))),
        t.customer.select(*triple(customer, skos + "broader", uri("n", "c_nationkey"), True)),
        t.region.select(*triple(F.lit(base + "g0"), taxonomies.RDF_TYPE, F.lit(skos + "Collection"), True)), t.region.select(*triple(F.lit(base + "g0"), skos + "prefLabel", F.lit("World"), False, F.lit("en"))),
        t.region.select(*triple(F.lit(base + "g0"), skos + "member", region, True)),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.distinct()


@query("skos_nodes", """SELECT 'http://example.org/place/c' || c_custkey AS uri, 'Concept' AS kind, c_name AS label, c_mktsegment AS aliases, c_mktsegment AS description FROM customer UNION ALL
SELECT 'http://example.org/place/n' || n_nationkey, 'Concept', n_name, '', '' FROM nation UNION ALL SELECT 'http://example.org/place/r' || r_regionkey, 'Concept', r_name, '', '' FROM region UNION ALL
SELECT 'http://example.org/place/g0', 'TaxonomyGroup', 'World', '', ''""")
def _skos(t):
    return taxonomies.skos_nodes(place_triples(t), "PLACES").select("uri", "kind", "label", F.array_join("aliases", "|").alias("aliases"), "description")


@query("skos_links", """SELECT 'BROADER_THAN' AS relation, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM nation) AS statements UNION ALL
SELECT 'HAS_MEMBER', (SELECT count(*) FROM region), (SELECT count(*) FROM region)""")
def _skos_links(t):
    triples = place_triples(t)
    edges, _, _ = taxonomies.skos_links(triples, taxonomies.skos_nodes(triples, "PLACES"), "PLACES")
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("statements")).cast("long").alias("statements"))


def part_release(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(concepts, descriptions, language refset, relationships) in RF2 form: parts below brands below the root."""
    root = F.lit(taxonomies.ROOT_CODE)
    brand = F.concat(F.lit("9"), F.regexp_extract("p_brand", r"(\d+)", 1))
    part = F.concat(F.lit("1"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    brands = t.part.select(brand.alias("id"), F.col("p_brand").alias("name")).distinct()
    concepts = t.part.select(part.alias("id")).unionByName(brands.select("id")).unionByName(t.region.select(root.alias("id")).distinct())
    full, synonym = F.lit(taxonomies.FULL_NAME), F.lit("900000000000013009")
    def description(rows, code, suffix, lang, kind, term):
        return rows.select(F.concat(code, F.lit(suffix)).alias("id"), code.alias("conceptId"), F.lit(lang).alias("languageCode"), kind.alias("typeId"), term.alias("term"))
    descriptions = (description(t.part, part, "f", "en", full, F.concat("p_name", F.lit(" "), F.lower("p_brand"), F.lit(" ("), F.lower("p_type"), F.lit(")")))
                    .unionByName(description(t.part, part, "s", "en", synonym, F.col("p_name"))).unionByName(description(t.part, part, "t", "fr", synonym, F.concat(F.lit("pièce "), "p_name")))
                    .unionByName(description(brands, F.col("id"), "f", "en", full, F.concat("name", F.lit(" (organism)"))))
                    .unionByName(description(t.region.select(root.alias("r")).distinct(), F.col("r"), "f", "en", full, F.lit("Root (root)"))))
    refset = descriptions.where(F.col("id").endswith("s")).select(F.col("id").alias("referencedComponentId"), F.lit(taxonomies.PREFERRED).alias("acceptabilityId"))
    def relation(rows, source, kind, target):
        return rows.select(F.concat(source, F.lit("-"), F.lit(kind), F.lit("-"), target).alias("id"), source.alias("sourceId"), target.alias("destinationId"), F.lit(kind).alias("typeId"))
    relationships = (relation(t.part, part, taxonomies.IS_A, brand).unionByName(relation(brands, F.col("id"), taxonomies.IS_A, root))
                     .unionByName(relation(t.part, part, "246075003", brand)))
    return concepts, descriptions, refset, relationships


RF2_BASE = """p AS (SELECT '1' || lpad(p_partkey::VARCHAR, 9, '0') AS code, '9' || regexp_extract(p_brand, '(\\d+)', 1) AS brand, * FROM part)"""


@query("rf2_nodes", f"""WITH {RF2_BASE}
SELECT code AS external_id, 'pièce ' || p_name AS label, array_to_string(list_sort([p_name, p_name || ' ' || lower(p_brand) || ' (' || lower(p_type) || ')']), '|') AS aliases FROM p UNION ALL
SELECT DISTINCT brand, p_brand || ' (organism)', '' FROM p UNION ALL SELECT '138875005', 'Root (root)', ''""")
def _rf2(t):
    concepts, descriptions, refset, _ = part_release(t)
    return taxonomies.rf2_nodes(concepts, descriptions, refset, "PARTS").select("external_id", "label", F.array_join("aliases", "|").alias("aliases"))


@query("rf2_edges", f"""WITH {RF2_BASE} SELECT 'BROADER_THAN' AS relation, count(*) + count(DISTINCT brand) AS n FROM p UNION ALL SELECT 'SEMANTIC_RELATION', count(*) FROM p""")
def _rf2_edges(t):
    return taxonomies.rf2_edges(part_release(t)[3], "PARTS").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("rf2_problems", f"""WITH {RF2_BASE} SELECT 'dangling' AS problem, code || '-246075003-' || brand AS id FROM p WHERE p_size > 40 UNION ALL SELECT 'dangling', code || '-116680003-' || brand FROM p WHERE p_size > 40
UNION ALL SELECT 'no_description', code FROM p WHERE p_size <= 40 AND p_size > 38""")
def _rf2_problems(t):
    concepts, descriptions, _, relationships = part_release(t)
    code = F.concat(F.lit("1"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id")
    big, mute = t.part.where("p_size > 40").select(code), t.part.where("p_size > 38").select(code.alias("conceptId"))
    return taxonomies.rf2_problems(concepts.join(big, "id", "left_anti"), descriptions.join(mute, "conceptId", "left_anti"), relationships)


@query("terminology", f"""WITH {RF2_BASE} SELECT code AS id, p_name || ' ' || lower(p_brand) || ' (' || lower(p_type) || ')' AS fsn, lower(p_type) AS tag, 2 AS depth FROM p UNION ALL
SELECT DISTINCT brand, p_brand || ' (organism)', 'organism', 1 FROM p UNION ALL SELECT '138875005', 'Root (root)', 'root', 0""")
def _terminology(t):
    concepts, descriptions, _, relationships = part_release(t)
    return taxonomies.terminology(concepts, descriptions, relationships)[0]


@query("term_resolution", f"""WITH {RF2_BASE},
terms AS (SELECT code AS concept, lower(p_name || ' ' || replace(p_brand, '#', ' ')) AS norm, 1 AS fsn FROM p UNION ALL SELECT code, p_name, 0 FROM p UNION ALL SELECT code, 'piece ' || p_name, 0 FROM p),
asked AS (SELECT p_partkey AS mention_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'spare ' || p_name || ' ' || lower(replace(p_brand, '#', ' ')) END AS norm FROM p),
ex AS (SELECT mention_id, max((fsn, 2, concept)) AS best FROM asked JOIN terms USING (norm) GROUP BY mention_id),
rest AS (SELECT mention_id, list_distinct(string_split(norm, ' ')) AS w FROM asked WHERE mention_id NOT IN (SELECT mention_id FROM ex)),
tw AS (SELECT DISTINCT norm, list_distinct(string_split(norm, ' ')) AS w FROM terms), rw AS (SELECT DISTINCT w FROM rest),
hit AS (SELECT rw.w AS mine, tw.norm, len(list_intersect(rw.w, tw.w)) / len(list_distinct(list_concat(rw.w, tw.w))) AS o FROM rw, tw WHERE len(list_intersect(rw.w, tw.w)) / len(list_distinct(list_concat(rw.w, tw.w))) >= 0.6),
best AS (SELECT mine, norm FROM hit QUALIFY o = max(o) OVER (PARTITION BY mine)),
code AS (SELECT mine, max(concept) AS concept FROM best JOIN terms USING (norm) GROUP BY mine)
SELECT mention_id, best[3] AS code FROM ex UNION ALL SELECT mention_id, concept FROM rest JOIN code ON rest.w = code.mine""")
def _resolve(t):
    concepts, descriptions, _, relationships = part_release(t)
    concept, term, _ = taxonomies.terminology(concepts, descriptions, relationships)
    mentions = t.part.select(F.col("p_partkey").alias("mention_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(
        F.concat_ws(" ", F.lit("spare"), "p_name", F.lower("p_brand"))).alias("term"), F.lit("").alias("tag"))
    return clinical.resolve_terms(mentions, term, concept).select("mention_id", "code")


def order_records(t) -> DataFrame:
    """Orders as statements about customers: finished ones present, open ones possible, pending ones absent; parts as concepts."""
    code = F.struct(F.concat(F.lit("sct:1"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("key"))
    parts = (t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(code)).alias("c"))
             .select("o_orderkey", F.transform("c", lambda c: F.struct(c["key"].alias("key"), c["key"].alias("term"), F.lit("product").alias("tag"))).alias("concepts")))
    state = F.when(F.col("o_orderstatus") == "F", F.lit("present")).when(F.col("o_orderstatus") == "O", F.lit("possible")).otherwise(F.lit("absent"))
    return t.orders.join(parts, "o_orderkey").select(
        F.col("o_custkey").alias("patient"), F.col("o_orderkey").cast("string").alias("memory_id"), F.lower("o_orderpriority").alias("text"), state.alias("state"), F.lit("patient").alias("subject"),
        F.lit("note").alias("source"), F.to_date("o_orderdate").alias("date"), F.to_date("o_orderdate").alias("doc_date"), F.lit(None).cast("string").alias("header"), "concepts")


def part_relations(t) -> DataFrame:
    return part_release(t)[3].select(F.col("sourceId").alias("source"), F.col("typeId").alias("type"), F.col("destinationId").alias("target"))


APPLY_SQL = f"""{RF2_BASE}, l AS (SELECT DISTINCT o_custkey AS patient, o_orderstatus AS st, code, brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN p ON p_partkey = l_partkey),
facts AS (SELECT DISTINCT patient, CASE st WHEN 'F' THEN 'present' WHEN 'O' THEN 'possible' ELSE 'absent' END AS state, unnest(CASE WHEN st IN ('F', 'O') THEN [code, brand, '138875005'] ELSE [code] END) AS code FROM l)"""


@query("patient_facts", f"WITH {APPLY_SQL} SELECT patient, state, code FROM facts")
def _facts(t):
    return clinical.patient_facts(cut_lineage(order_records(t)), part_relations(t))


@query("applicability", f"""WITH {APPLY_SQL},
recs AS (SELECT brand AS rec_id, brand, min(code) AS first_part, max(code) AS last_part FROM p GROUP BY brand),
pairs AS (SELECT DISTINCT patient, brand AS rec_id FROM l),
asked AS (SELECT rec_id AS code FROM recs UNION SELECT first_part FROM recs UNION SELECT last_part FROM recs),
has AS MATERIALIZED (SELECT patient, code, bool_or(state = 'present') AS pr, bool_or(state = 'possible') AS po, bool_or(state = 'absent') AS ab FROM facts JOIN asked USING (code) GROUP BY ALL),
urgent AS (SELECT DISTINCT o_custkey AS patient FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
j AS (SELECT a.patient, a.rec_id, b.pr, b.po, b.ab, coalesce(e.pr, false) AS excluded, coalesce(c.pr, false) AS cp, coalesce(c.po, false) AS co, coalesce(c.ab, false) AS ca, u.patient IS NOT NULL AS urgent
  FROM pairs a JOIN recs r USING (rec_id) LEFT JOIN has b ON b.patient = a.patient AND b.code = r.brand LEFT JOIN has e ON e.patient = a.patient AND e.code = r.first_part
  LEFT JOIN has c ON c.patient = a.patient AND c.code = r.last_part LEFT JOIN urgent u ON u.patient = a.patient)
SELECT patient, rec_id, round(CASE WHEN excluded THEN 0.0 ELSE (CASE WHEN pr THEN 1.0 WHEN ab THEN 0.05 WHEN po THEN 0.6 ELSE 0.2 END) * (CASE WHEN urgent THEN 0.9 ELSE 0.35 END)
  * (CASE WHEN cp THEN 1.0 WHEN ca THEN 0.05 WHEN co THEN 0.6 ELSE 0.2 END) END::DOUBLE, 6) AS factor FROM j""")
def _apply(t):
    records, relations = cut_lineage(order_records(t)), part_relations(t)  # read by pairs, facts and findings
    part = F.concat(F.lit("1"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    brand = F.concat(F.lit("9"), F.regexp_extract("p_brand", r"(\d+)", 1))
    codes = t.part.select(part.alias("part"), brand.alias("rec_id"))
    def item(c):
        return F.struct(F.concat(F.lit("sct:"), c).alias("key"), c.alias("term"))
    recs = codes.groupBy("rec_id").agg(F.min("part").alias("first"), F.max("part").alias("last")).select(
        "rec_id", F.array(item(F.col("rec_id")), F.struct(F.lit("txt:urgent").alias("key"), F.lit("urgent").alias("term")), item(F.col("last"))).alias("conditions"), F.array(item(F.col("first"))).alias("exclusions"))
    pairs = (records.select("patient", F.explode("concepts").alias("c")).select("patient", clinical.code_of("c.key").alias("part")).join(codes, "part").select("patient", "rec_id").distinct())
    judged = clinical.applicability(recs, pairs, clinical.patient_facts(records, relations), records)
    return judged.select("patient", "rec_id", F.round("factor", 6).alias("factor"))


# Every tenth of the first parts is a result the header shows, kinds of one brand are allergies, every third part is a disorder.
HEADER_CODES = [f"sct:1{n:09d}" for n in range(10, 1001, 10)]
ALLERGY_ROOT = "911"


@query("patient_header", f"""WITH {RF2_BASE}, m AS (SELECT o_custkey AS patient, o_orderkey::VARCHAR AS id, o_orderdate::DATE AS d, CASE o_orderstatus WHEN 'F' THEN 'present' ELSE 'possible' END AS state, o_orderkey % 7 = 0 AS stored
  FROM orders WHERE o_orderstatus IN ('F', 'O')),
c AS (SELECT l_orderkey::VARCHAR AS id, bool_or(coalesce(brand = '{ALLERGY_ROOT}', false)) AS allergy, min('sct:1' || lpad(l_partkey::VARCHAR, 9, '0')) FILTER (l_partkey % 3 = 0) AS disorder,
  min('sct:1' || lpad(l_partkey::VARCHAR, 9, '0')) FILTER (l_partkey % 10 = 0 AND l_partkey <= 1000) AS result FROM lineitem LEFT JOIN p ON p_partkey = l_partkey GROUP BY 1),
s AS (SELECT *, CASE WHEN stored THEN 'medications' WHEN allergy THEN 'allergies' WHEN disorder IS NOT NULL THEN 'problems' WHEN result IS NOT NULL THEN 'results' END AS slot FROM m JOIN c USING (id)),
i AS (SELECT *, CASE slot WHEN 'results' THEN coalesce(result, id) WHEN 'problems' THEN coalesce(disorder, id) ELSE id END AS item FROM s WHERE slot IS NOT NULL AND (state <> 'possible' OR slot = 'problems'))
SELECT patient, slot, item, arg_max(id, (d, id)) AS memory_id, arg_max(state, (d, id)) AS state FROM i GROUP BY ALL""")
def _header(t):
    tagged = F.transform("concepts", lambda c: F.struct(c["key"].alias("key"), c["term"].alias("term"),
                                                        F.when(F.substring(c["key"], 6, 9).cast("long") % 3 == 0, F.lit("disorder")).otherwise(c["tag"]).alias("tag")))
    records = order_records(t).withColumn("concepts", tagged).withColumn("header", F.when(F.col("memory_id").cast("long") % 7 == 0, F.lit("medications")))
    slots = clinical.header_slots(records, part_relations(t), [ALLERGY_ROOT], HEADER_CODES)
    return clinical.patient_header(slots, HEADER_CODES).select("patient", "slot", "item", "memory_id", "state")


@query("concept_expansion", f"""WITH {RF2_BASE} SELECT 'e:sct:' || code AS src, 'e:sct:' || brand AS dst, 'sct:' || t AS kind FROM p, (VALUES ('116680003'), ('246075003')) v(t) UNION ALL
SELECT DISTINCT 'e:sct:' || brand, 'e:sct:138875005', 'sct:116680003' FROM p""")
def _expansion(t):
    """The whole neighbourhood, the root included."""
    concepts, descriptions, _, relationships = part_release(t)
    concept, _, relation = taxonomies.terminology(concepts, descriptions, relationships)
    codes = concepts.where(F.col("id").startswith("1") & (F.length("id") == 10)).select(F.col("id").alias("code"))
    return clinical.expansion_links(codes, relation, concept, spreading.clinical_params().edge_weights, 3, 0)


@query("fhir_memories", """SELECT o_orderkey::VARCHAR AS resource_id, CASE o_orderstatus WHEN 'F' THEN 'order value: ' || o_totalprice::VARCHAR || ' EUR (H)' WHEN 'O' THEN o_orderpriority || ' (active)' ELSE 'Medication: ' || o_orderpriority || ' (status unknown)' END AS text,
  CASE o_orderstatus WHEN 'O' THEN 'problems' WHEN 'F' THEN 'results' END AS header, CASE o_orderstatus WHEN 'F' THEN 'lab' ELSE 'structured' END AS source, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""")
def _fhir(t):
    status = F.col("o_orderstatus")
    def concept(text, system=None, code=None):
        coding = (F.array(F.struct(F.lit(system).alias("system"), F.lit(code).alias("code"), text.alias("display"))) if code else
                  F.array().cast("array<struct<system:string,code:string,display:string>>"))
        return F.struct(text.alias("text"), coding.alias("coding")).cast(fhir.CONCEPT)
    none = F.lit(None)
    observed, condition = status == "F", status == "O"
    rows = t.orders.select(
        F.when(observed, F.lit("Observation")).when(condition, F.lit("Condition")).otherwise(F.lit("MedicationStatement")).alias("resourceType"),
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("patient"),
        F.when(observed, concept(F.lit("order value"), fhir.LOINC_SYSTEM, "1-1")).when(condition, concept(F.col("o_orderpriority"))).alias("code"),
        F.when(~observed & ~condition, concept(F.col("o_orderpriority"))).alias("medicationCodeableConcept"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("effectiveDateTime"), *[none.cast("string").alias(c) for c in ("onsetDateTime", "recordedDate", "issued", "dateAsserted")],
        none.cast("struct<start:string>").alias("effectivePeriod"), none.cast(fhir.CONCEPT).alias("verificationStatus"),
        F.when(condition, concept(F.lit("active"), "s", "active")).alias("clinicalStatus"),
        F.when(observed, F.struct(F.col("o_totalprice").cast("string").alias("value"), F.lit("EUR").alias("unit"), F.lit("").alias("code"))).alias("valueQuantity"),
        none.cast(fhir.CONCEPT).alias("valueCodeableConcept"), none.cast("string").alias("valueString"),
        F.when(observed, F.array(concept(F.lit("high"), "s", "H"))).alias("interpretation"), none.cast(f"array<struct<manifestation:array<{fhir.CONCEPT}>>>").alias("reaction"),
        none.cast("string").alias("status"), none.cast("array<struct<text:string>>").alias("dosage"))
    return fhir.fhir_memories(rows, ["loinc:1-1"]).select("resource_id", "text", "header", "source", F.col("date").cast("string").alias("date"))
