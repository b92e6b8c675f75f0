"""Clinical steps read their input once and judge pairs where they meet their items."""

from lorekeep.operators import clinical, patients
from lorekeep.plans import catalog

SF = "/root/testdata/sf0.001"
KEY = "array<struct<key:string,term:string,tag:string>>"


def reads(frame, table):
    return any(f"/{table}.parquet" in f for f in frame.inputFiles())


def test_facts_are_written_before_the_rounds_judge(spark, monkeypatch):
    plans, real = [], patients.applicability
    monkeypatch.setattr(patients, "applicability", lambda r, p, f, m: plans.append(f._jdf.queryExecution().optimizedPlan().toString()) or real(r, p, f, m))
    catalog.QUERIES["patient_ask"](spark, SF)
    assert plans and not any("Aggregate" in p or "Join" in p for p in plans)


def test_no_allergy_roots_close_nothing(spark, monkeypatch):
    starts, real = [], clinical.closure
    monkeypatch.setattr(clinical, "closure", lambda s, *a, **k: starts.append(s.count()) or real(s, *a, **k))
    rows = spark.createDataFrame([("m1", "note", "patient", "present", None, [("sct:5", "five", "x")])], f"memory_id string, source string, subject string, state string, header string, concepts {KEY}")
    up = spark.createDataFrame([("5", "116680003", "1")], "source string, type string, target string")
    assert clinical.header_slots(rows, up, [], ["sct:5"]).select("slot").collect()[0].slot == "results"
    assert clinical.header_slots(rows, up, ["1"], []).select("slot").collect()[0].slot == "allergies"
    assert starts == [0, 1]


def test_applicability_of_odd_items(spark):
    """Null keys count for nothing, a null patient has no states, words of one item need one finding."""
    item = "array<struct<key:string,term:string>>"
    recs = spark.createDataFrame([("r", [("sct:1", "one"), (None, "none"), ("txt:a b", "ab"), ("txt:", "empty")], None), ("s", None, [("sct:2", "two")]), ("n", [], None)],
                                 f"rec_id string, conditions {item}, exclusions {item}")
    pairs = spark.createDataFrame([(1, "r"), (None, "r"), (1, "s"), (2, "s"), (1, "n"), (1, "gone")], "patient long, rec_id string")
    facts = spark.createDataFrame([(1, "present", "1"), (1, "absent", "1"), (1, "possible", "2"), (2, "present", "2"), (1, "present", "9")], "patient long, state string, code string")
    memories = spark.createDataFrame([(1, "m1", "A x"), (1, "m2", "b"), (2, "m3", "a b")], "patient long, memory_id string, text string").selectExpr(
        "*", "'present' AS state", "'patient' AS subject", "'note' AS source")
    got = {(r.patient, r.rec_id): r for r in clinical.applicability(recs, pairs, facts, memories).collect()}
    assert len(got) == 6
    assert round(got[1, "r"].factor, 9) == 0.1225 and got[1, "r"].met == ["one"] and got[1, "r"].unverified == ["ab", "empty"]
    assert got[None, "r"].factor == 0.35 and got[None, "r"].unverified == []
    assert got[1, "s"].factor == 0.35 and got[2, "s"].factor == 0 and got[2, "s"].excluded_by == ["two"]
    assert got[1, "n"].factor == got[1, "gone"].factor == 0.35


def test_pairs_are_judged_without_a_row_per_item(spark):
    plan = catalog.QUERIES["applicability"](spark, SF)
    assert not reads(plan, "lineitem")
    assert "product(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_erasure_reads_its_records_once(spark):
    assert not reads(catalog.QUERIES["clinical_erasure"](spark, SF), "lineitem")
