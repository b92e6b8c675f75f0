import random

from pyspark.sql import functions as F

from lorekeep.operators import clinical, patients

ITEM = "array<struct<key:string,term:string>>"


def test_best_recommendations_without_judging_all(spark, monkeypatch):
    """Values equal those of judging every pair; pairs whose score can't reach the last kept value are not judged."""
    random.seed(8)
    states = ("present", "possible", "absent")
    facts = [(p, s, f"c{random.randrange(12)}") for p in range(6) for s in states for _ in range(3)]
    recs = [(f"r{i:02}", [(f"sct:c{random.randrange(12)}", "t")] if i % 3 else [], [("sct:c1", "x")] if i % 5 == 0 else []) for i in range(40)]
    scored = [(q, q % 6, f"r{i:02}", 0.9 ** i + q / 1000) for q in range(9) for i in range(40) if (q + i) % 4]
    scored += [(50, 1, "r01", 0.0), (51, 2, "r00", 0.5)]
    frame = spark.createDataFrame(scored, "query_id long, patient long, rec_id string, score double")
    recommendations = spark.createDataFrame(recs, f"rec_id string, conditions {ITEM}, exclusions {ITEM}")
    known = spark.createDataFrame(sorted(set(facts)), "patient long, state string, code string")
    memories = spark.createDataFrame([], "memory_id string, patient long, text string, state string, subject string, source string")
    judged = []
    real = patients.applicability
    monkeypatch.setattr(patients, "applicability", lambda r, p, f, m: judged.append(p.count()) or real(r, p, f, m))
    found = {(r.query_id, r["rank"]): (r.rec_id, r.value) for r in patients.best_applicable(frame, recommendations, known, memories, keep=3, first=4).collect()}
    assert sum(judged) < frame.select("patient", "rec_id").distinct().count()
    whole = {(r.patient, r.rec_id): r.factor for r in real(recommendations, frame.select("patient", "rec_id").distinct(), known, memories).collect()}
    want = {}
    for q in {r[0] for r in scored}:
        values = sorted((-round(s * whole[p, rec], 4), rec) for query, p, rec, s in scored if query == q and s > 0 and whole[p, rec] > 0)
        want |= {(q, n): (rec, -v) for n, (v, rec) in enumerate(values[:3], 1)}
    assert found == want


def test_header_block_and_citations(spark):
    concept = "array<struct<key:string,term:string,tag:string>>"
    memories = spark.createDataFrame([
        ("m1", 1, "Penicillin allergy", "present", "patient", "note", "2024-01-01", None, [("sct:11", "a", "disorder")]),
        ("m2", 1, "Diabetes", "possible", "patient", "note", "2024-01-02", None, [("sct:20", "d", "disorder")]),
        ("m3", 1, "Diabetes again", "present", "patient", "note", "2024-02-02", None, [("sct:20", "d", "disorder")]),
        ("m4", 1, "HbA1c 7", "present", "patient", "lab", "2024-01-03", "results", []), ("m5", 1, "From a model", "present", "patient", "ai", "2024-01-03", "results", []),
        ("m6", 1, "Mother's gout", "present", "mother", "note", "2024-01-03", "problems", [])],
        f"memory_id string, patient long, text string, state string, subject string, source string, date string, header string, concepts {concept}").withColumn("doc_date", F.col("date"))
    relations = spark.createDataFrame([("11", clinical.IS_A, "10")], "source string, type string, target string")
    header = clinical.patient_header(clinical.header_slots(memories, relations, ["10"], ["sct:99"]), ["sct:99"])
    rows = header.withColumn("query_id", F.lit(7))
    shown = memories.where("memory_id in ('m3', 'm4')").withColumn("query_id", F.lit(7)).withColumn("rank", F.when(F.col("memory_id") == "m4", 1).otherwise(2))
    recs = spark.createDataFrame([(7, 1, "g1", "Treat it.", "Guide", "", ["a", "b"], [], ["c"], [])],
                                 "query_id int, rank int, rec_id string, text string, guideline string, strength string, met array<string>, possible array<string>, unverified array<string>, not_met array<string>")
    block = patients.evidence(rows, shown, recs)
    assert patients.evidence_texts(block).first()["text"].split("\n") == [
        "PATIENT HEADER", "[H1] allergies: Penicillin allergy (2024-01-01, note)", "[H2] problems: Diabetes again (2024-02-02, note)", "[H3] results: HbA1c 7 (2024-01-03, lab)", "",
        "PATIENT MEMORIES (most relevant first)", "[P1] 2024-01-03 (present, lab) HbA1c 7", "[P2] 2024-02-02 (present, note) Diabetes again", "",
        "GUIDELINE RECOMMENDATIONS (best fit first)", "[G1] Guide (strength not stated) Treat it. | fit: met: a, b; unverified: c"]
    answers = spark.createDataFrame([(7, "G1 and [P2], H9, xP1, P2 and H2.")], "query_id int, answer string")
    cited = patients.cited_statements(answers, block).orderBy("place").collect()
    assert [r.memory_id for r in cited] == ["g1", "m3"]
