"""A patient's question: ranked statements and recommendations that fit, a numbered evidence block, and citations back to statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, is_empty
from .clinical import applicability
from .skew import top_per_group

#: Order of the header's lists, and how many statements and recommendations are shown.
HEADER = ("allergies", "medications", "problems", "results")
MEMORIES, RECOMMENDATIONS = 12, 6


def best_applicable(scored: DataFrame, recommendations: DataFrame, facts: DataFrame, memories: DataFrame, keep: int = RECOMMENDATIONS, first: int = 2 * RECOMMENDATIONS) -> DataFrame:
    """Per query the `keep` recommendations with the largest score times applicability, rounded to 4 digits; none that is excluded.

    scored: query_id, patient, rec_id, score. Applicability is at most 1, so a recommendation's score bounds its value: they are judged by falling score, a
    growing number each round, until no open one can reach the last kept value. Pairs below that bound are never judged.
    """
    ranked = cut_lineage(scored.where("score > 0").withColumn("__place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rec_id"))))
    judged, low, size = None, 0, first
    open_ = ranked
    while True:
        batch = cut_lineage(open_.where(F.col("__place") <= low + size))
        if is_empty(batch):
            if is_empty(open_):
                break
        else:
            fit = applicability(recommendations, batch.select("patient", "rec_id").distinct(), facts, memories)
            found = batch.join(fit, ["patient", "rec_id"]).withColumn("value", F.round(F.col("score") * F.col("factor"), 4))
            judged = cut_lineage(found if judged is None else judged.unionByName(found))
        low, size = low + size, 2 * size
        if judged is None:
            continue
        best = top_per_group(judged.where("factor > 0"), ["query_id"], [F.desc("value"), F.col("rec_id")], keep)
        last = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("last")).where(F.col("n") >= keep).select("query_id", "last")
        bounded = ranked.where(F.col("__place") > low).join(last, "query_id", "left")
        open_ = cut_lineage(bounded.where(F.col("last").isNull() | (F.round("score", 4) >= F.col("last"))).drop("last"))
        if is_empty(open_):
            break
    if judged is None:
        fit = applicability(recommendations, ranked.select("patient", "rec_id"), facts, memories)
        judged = ranked.join(fit, ["patient", "rec_id"]).withColumn("value", F.round(F.col("score") * F.col("factor"), 4))
    return top_per_group(judged.where("factor > 0").drop("__place"), ["query_id"], [F.desc("value"), F.col("rec_id")], keep)


def evidence(header: DataFrame, memories: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(query_id, label, memory_id, line): the numbered block, H for the header, P for the patient's statements, G for guidelines.

    header: query_id, slot, item, memory_id, text, date, source, state; memories: query_id, rank, memory_id, text, date, source, state; recommendations: query_id, rank,
    rec_id, text, guideline, strength and the lists of `applicability`.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.array_position(F.array(*[F.lit(s) for s in HEADER]), F.col("slot")), "item"))
    state = F.when(F.col("state") == "present", "").otherwise(F.concat("state", F.lit(", ")))
    h = header.withColumn("label", F.concat(F.lit("H"), place.cast("string")))
    line = F.format_string("[%s] %s: %s (%s%s, %s)", "label", "slot", "text", state, F.col("date").cast("string"), "source")
    rows = h.select("query_id", "label", "memory_id", line.alias("line"))
    p = memories.where(F.col("rank") <= MEMORIES).withColumn("label", F.concat(F.lit("P"), F.col("rank").cast("string")))
    line = F.format_string("[%s] %s (%s, %s) %s", "label", F.col("date").cast("string"), "state", "source", "text")
    rows = rows.unionByName(p.select("query_id", "label", "memory_id", line.alias("line")))
    g = recommendations.where(F.col("rank") <= RECOMMENDATIONS).withColumn("label", F.concat(F.lit("G"), F.col("rank").cast("string")))
    fit = F.concat_ws("; ", *[F.when(F.size(k) > 0, F.concat(F.lit(k.replace("_", " ") + ": "), F.array_join(k, ", "))) for k in ("met", "possible", "unverified", "not_met")])
    strength = F.when(F.coalesce("strength", F.lit("")) == "", "strength not stated").otherwise(F.col("strength"))
    line = F.format_string("[%s] %s (%s) %s | fit: %s", "label", "guideline", strength, "text", fit)
    return rows.unionByName(g.select("query_id", "label", F.col("rec_id").alias("memory_id"), line.alias("line")))


def evidence_texts(block: DataFrame) -> DataFrame:
    """(query_id, text): the block's lines under their headings, header first, then statements and guidelines in their order."""
    mark = F.substring("label", 1, 1)
    order = F.struct(F.array_position(F.array(F.lit("H"), F.lit("P"), F.lit("G")), mark).alias("part"), F.expr("cast(substring(label, 2) as int)").alias("n"), "line")
    lines = block.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("l"))
    def part(number, title):
        return F.concat(F.array(F.lit(title)), F.transform(F.filter("l", lambda x: x["part"] == number), lambda x: x["line"]), F.array(F.lit("")))
    text = F.array_join(F.concat(part(1, "PATIENT HEADER"), part(2, "PATIENT MEMORIES (most relevant first)"), part(3, "GUIDELINE RECOMMENDATIONS (best fit first)")), "\n")
    return lines.select("query_id", F.regexp_replace(text, r"\n$", "").alias("text"))


def cited_statements(answers: DataFrame, block: DataFrame) -> DataFrame:
    """(query_id, place, memory_id): the statements an answer cites by label, each once in order of first mention; unknown labels count for nothing."""
    named = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\b([HPG]\d+)\b"), F.lit(1))).alias("place", "label"))
    found = named.join(block.select("query_id", "label", "memory_id"), ["query_id", "label"]).groupBy("query_id", "memory_id").agg(F.min("place").alias("place"))
    return found.select("query_id", "place", "memory_id")


def guideline_listing(documents: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Guideline documents with the number of their recommendations and of sections that failed. documents: document_id, ..., failed_sections."""
    counts = recommendations.groupBy("document_id").agg(F.count(F.lit(1)).alias("recommendations"))
    return documents.join(counts, "document_id", "left").withColumn("recommendations", F.coalesce("recommendations", F.lit(0)))


def patient_ask(questions: DataFrame, ranked: DataFrame, scored: DataFrame, header: DataFrame, statements: DataFrame, recommendations: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, label, memory_id, line) for every question: header, the best statements and the best recommendations that apply.

    questions: query_id, patient; ranked: query_id, memory_id, score of the patient's statements; scored: query_id, rec_id, score of recommendations; header: what
    `clinical.patient_header` gives; statements: memory_id, patient and what the block shows.
    """
    shown = top_per_group(ranked, ["query_id"], [F.desc("score"), F.col("memory_id")], MEMORIES).join(
        statements.where("source <> 'guideline'").select("memory_id", "text", "date", "source", "state"), "memory_id")
    facts = cut_lineage(facts)  # each round reads them
    best = best_applicable(scored.join(questions.select("query_id", "patient"), "query_id"), recommendations, facts, statements)
    best = best.join(recommendations.select("rec_id", "text", "guideline", "strength"), "rec_id")
    return evidence(header.join(questions.select("query_id", "patient"), "patient"), shown, best)
