"""FHIR R4 resources as memories: text, state, date, header slot and codings, from their codes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import iso_date

# Code systems and how statuses are read.
SNOMED_SYSTEM, LOINC_SYSTEM = "http://snomed.info/sct", "http://loinc.org"
CONCEPT = "struct<text:string,coding:array<struct<system:string,code:string,display:string>>>"
SCHEMA = (
    f"resourceType string, id string, patient string, code {CONCEPT}, medicationCodeableConcept {CONCEPT}, "
    f"effectiveDateTime string, onsetDateTime string, recordedDate string, issued string, dateAsserted string, effectivePeriod struct<start:string>, "
    f"verificationStatus {CONCEPT}, clinicalStatus {CONCEPT}, valueQuantity struct<value:string,unit:string,code:string>, valueCodeableConcept {CONCEPT}, valueString string, "
    f"interpretation array<{CONCEPT}>, reaction array<struct<manifestation:array<{CONCEPT}>>>, status string, dosage array<struct<text:string>>"
)
KINDS = ["Observation", "Condition", "AllergyIntolerance", "MedicationStatement"]


def read_fhir(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def _no_codings() -> Column:
    return F.array().cast("array<struct<system:string,code:string,display:string>>")


def _first_display(concept: Column) -> Column:
    shown = F.filter(F.coalesce(concept["coding"], _no_codings()), lambda c: F.coalesce(c["display"], F.lit("")) != "")
    return F.get(shown, F.lit(0))["display"]


def _status(concept: Column) -> Column:
    return F.coalesce(F.get(F.coalesce(concept["coding"], _no_codings()), F.lit(0))["code"], F.lit(""))


def _codes(concept: Column, display: Column) -> Column:
    """Codings of known systems as (key, term, tag-to-be-filled, analyte) structs."""
    rows = F.filter(F.coalesce(concept["coding"], _no_codings()), lambda c: (c["system"].isin(SNOMED_SYSTEM, LOINC_SYSTEM)) & (F.coalesce(c["code"], F.lit("")) != ""))
    return F.transform(rows, lambda c: F.struct(
        F.concat(F.when(c["system"] == SNOMED_SYSTEM, F.lit("sct:")).otherwise(F.lit("loinc:")), c["code"]).alias("key"),
        F.coalesce(F.when(c["display"] != "", c["display"]), display).alias("term"),
        F.when(c["system"] == LOINC_SYSTEM, F.lit("observable entity")).alias("tag")))


def fhir_memories(resources: DataFrame, header_codes: list[str], day: Column | None = None, text_chars: int = 600) -> DataFrame:
    """One memory per supported resource; others are ignored. SNOMED tags are filled by `fill_tags`.

    A resource without a date gets `day`, by default the day of the job. `text` holds at most `text_chars` characters, as
    such memories are defined; `full_text` holds all of it.
    """
    rows = resources.where(F.col("resourceType").isin(KINDS))
    kind = F.col("resourceType")
    code = F.when(kind == "MedicationStatement", F.col("medicationCodeableConcept")).otherwise(F.col("code"))
    rows = rows.withColumn("__code", code).withColumn("__display", F.coalesce(F.when(F.col("__code.text") != "", F.col("__code.text")), _first_display(F.col("__code")), F.lit("unnamed")))
    verification, clinical = _status(F.col("verificationStatus")), _status(F.col("clinicalStatus"))
    state = (F.when(verification.isin("refuted", "entered-in-error"), F.lit("absent"))
             .when(verification.isin("provisional", "differential", "unconfirmed"), F.lit("possible")).otherwise(F.lit("present")))
    coded_value = F.col("valueCodeableConcept")
    coded_text = F.coalesce(F.when(coded_value["text"] != "", coded_value["text"]), _first_display(coded_value), F.lit(""))
    quantity = F.col("valueQuantity")
    unit = F.coalesce(F.when(quantity["unit"] != "", quantity["unit"]), quantity["code"], F.lit(""))
    value = (F.when(quantity.isNotNull(), F.trim(F.concat(F.coalesce(quantity["value"], F.lit("None")), F.lit(" "), unit)))
             .when(coded_value.isNotNull(), coded_text).otherwise(F.coalesce("valueString", F.lit(""))))
    flags = F.array_join(F.transform(F.flatten(F.transform(F.coalesce("interpretation", F.array().cast(f"array<{CONCEPT}>")), lambda i: F.coalesce(i["coding"], _no_codings()))),
                                     lambda c: F.coalesce(c["code"], F.lit(""))), ",")
    found = F.flatten(F.transform(F.coalesce("reaction", F.array().cast(f"array<struct<manifestation:array<{CONCEPT}>>>")), lambda r: r["manifestation"]))
    reactions = F.array_join(F.filter(F.transform(found, lambda m: F.coalesce(F.when(m["text"] != "", m["text"]), F.get(m["coding"], F.lit(0))["display"], F.lit(""))), lambda x: x != ""), ", ")
    dosage = F.array_join(F.filter(F.transform(F.coalesce("dosage", F.array().cast("array<struct<text:string>>")), lambda d: F.coalesce(d["text"], F.lit(""))), lambda x: x != ""), "; ")
    shown = F.when(clinical != "", clinical).otherwise(F.lit("status unknown"))
    status = F.coalesce("status", F.lit(""))
    text = (F.when(kind == "Observation", F.concat("__display", F.lit(": "), value, F.when(flags != "", F.concat(F.lit(" ("), flags, F.lit(")"))).otherwise(F.lit(""))))
            .when(kind == "Condition", F.concat("__display", F.lit(" ("), shown, F.lit(")")))
            .when(kind == "AllergyIntolerance", F.concat(F.lit("Allergy or intolerance: "), "__display", F.when(reactions != "", F.concat(F.lit(" (reaction: "), reactions, F.lit(")"))).otherwise(F.lit(""))))
            .otherwise(F.concat(F.lit("Medication: "), "__display", F.when(dosage != "", F.concat(F.lit(", "), dosage)).otherwise(F.lit("")),
                                F.lit(" ("), F.when(status != "", status).otherwise(F.lit("status unknown")), F.lit(")"))))
    own = _codes(F.col("__code"), F.col("__display"))
    nothing = F.array().cast("array<struct<key:string,term:string,tag:string>>")
    extra = F.when((kind == "Observation") & quantity.isNull() & coded_value.isNotNull(), _codes(coded_value, coded_text)).otherwise(nothing)
    concepts = F.concat(own, extra)
    header = (F.when((kind == "Observation") & F.exists(concepts, lambda c: c["key"].isin(header_codes or [""])), F.lit("results"))
              .when((kind == "Condition") & (state == "present") & clinical.isin("active", "recurrence", "relapse"), F.lit("problems"))
              .when((kind == "AllergyIntolerance") & (state == "present") & clinical.isin("", "active"), F.lit("allergies"))
              .when((kind == "MedicationStatement") & status.isin("active", "intended"), F.lit("medications")))
    when = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("effectiveDateTime", "onsetDateTime", "recordedDate", "issued", "dateAsserted")], F.col("effectivePeriod.start"))
    return rows.select("patient", F.col("id").alias("resource_id"), kind.alias("resource_type"), F.substring(text, 1, text_chars).alias("text"), text.alias("full_text"), state.alias("state"),
                       F.lit("patient").alias("subject"), F.coalesce(iso_date(when), F.date_format(F.current_date() if day is None else day, "yyyy-MM-dd")).alias("date"), F.lit(1.0).alias("confidence"),
                       F.when(kind == "Observation", F.lit("lab")).otherwise(F.lit("structured")).alias("source"), concepts.alias("concepts"), header.alias("header"))


def fill_tags(memories: DataFrame, concepts: DataFrame, key: str = "resource_id") -> DataFrame:
    """Known SNOMED codes get their semantic tag; unknown ones are dropped from the concept list."""
    rows = memories.select(key, F.posexplode("concepts").alias("n", "c"))
    tags = concepts.select(F.concat(F.lit("sct:"), "id").alias("k"), F.col("tag").alias("t"))
    joined = rows.join(tags, F.col("c.key") == F.col("k"), "left").where(~F.col("c.key").startswith("sct:") | F.col("t").isNotNull())
    lists = joined.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(
        F.col("c.key").alias("key"), F.col("c.term").alias("term"), F.coalesce("t", "c.tag").alias("tag")).alias("c")))), lambda x: x["c"]).alias("concepts"))
    return memories.drop("concepts").join(lists, key, "left").withColumn(
        "concepts", F.coalesce("concepts", F.array().cast("array<struct<key:string,term:string,tag:string>>")))


def analyte_terms(memories: DataFrame, key: str = "resource_id") -> DataFrame:
    """(mention_id, term, tag): the drug or analyte named before the bracket of a LOINC display, to be resolved too."""
    return (memories.select(key, F.explode("concepts").alias("c")).where(F.col("c.key").startswith("loinc:") & F.col("c.term").contains("["))
            .select(F.col(key).alias("mention_id"), F.trim(F.substring_index("c.term", "[", 1)).alias("term"), F.lit("substance").alias("tag")))
