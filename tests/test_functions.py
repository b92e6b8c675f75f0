"""Column functions against plain Python on multilingual texts and worked cases."""

import datetime as dt
import hashlib
import re
import unicodedata
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import answers, ids, text, vectors

TEXTS = ["Straße ÉTÉ naïve Œuvre", "Endocardites bactériennes, class glass", "ΟΔΟΣ Σίσυφος", "日本語 テスト 42", "ﬁne ½ cup… ﬀ", "a_b c-d", "", "x" * 50]


def rows_of(spark, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    return [r[1] for r in df.select("id", expr).orderBy("id").collect()]


def test_words_match_case_folded_runs(spark):
    got = rows_of(spark, text.words(F.col("t")))
    assert [set(g) for g in got] == [set(re.findall(r"[^\W_]+", t.casefold())) for t in TEXTS]


def test_norm_folds_accents_and_plurals(spark):
    def plain(value):
        folded = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
        return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in re.findall(r"\w+", folded)]
    assert rows_of(spark, text.norm_words(F.col("t"))) == [plain(t) for t in TEXTS]


def test_terms_fall_back_to_all_words(spark):
    df = spark.createDataFrame([("what is the",), ("the piano",)], "t string")
    assert [sorted(r[0]) for r in df.select(text.terms(F.col("t"))).collect()] == [["is", "the", "what"], ["piano"]]


def test_uuid5_equals_python(spark):
    got = rows_of(spark, ids.uuid5_url(F.col("t")))
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in TEXTS]


@pytest.mark.parametrize("cue, expected", [
    ("3 weeks ago", ("2023-05-06", "2023-05-12")), ("in the past month", ("2023-04-30", "2023-05-30")), ("yesterday", ("2023-05-29", "2023-05-29")),
    ("in June", ("2022-06-01", "2022-06-30")), ("in March 2021", ("2021-03-01", "2021-03-31")), ("the last two weeks", ("2023-05-16", "2023-05-30")), ("no cue", None)])
def test_time_window(spark, cue, expected):
    now = F.lit(dt.date(2023, 5, 30))
    got = spark.createDataFrame([(cue,)], "t string").select(text.time_window(F.col("t"), now).alias("w")).first()["w"]
    assert (got and (str(got["start"]), str(got["end"]))) == expected


@pytest.mark.parametrize("memory, session, bad", [
    ("The learner runs setAll() often.", "x", True), ("It was cut off...", "x", True), ("学习者", "le cours", True), ("学习者", "学习", False),
    ("the learner was with the lesson and after", "le la les de et une des du que pour", True), ("A clean sentence.", "x", False)])
def test_corrupted(spark, memory, session, bad):
    df = spark.createDataFrame([(memory, session)], "m string, s string")
    assert df.select(text.corrupted(F.col("m"), F.col("s"))).first()[0] is bad


def test_hash_embedding(spark):
    def plain(value):
        out = np.zeros(64)
        for w in set(re.findall(r"[^\W_]+", value.casefold())):
            out[int.from_bytes(hashlib.sha256(w.encode()).digest()[:2], "big") % 64] += 1
        return out / (np.sqrt((out * out).sum()) or 1)
    got = rows_of(spark, vectors.hash_embedding(F.col("t")))
    for g, t in zip(got, TEXTS):
        assert np.allclose(g, plain(t))


def test_citations_and_verdicts(spark):
    df = spark.createDataFrame([("Yes [a, b] and [zz] again [a].", ["a", "b"])], "t string, k array<string>")
    t, k = F.col("t"), F.col("k")
    row = df.select(answers.cited(t, k), answers.without_citations(t, k), answers.answer_words(t, k)).first()
    assert list(row) == [["a", "b"], "Yes and [zz] again.", 4]
    verdict = spark.createDataFrame([('x {"correct": "true", "major_omission": false, "reason": "r"} y',), ('{"correct": true}',)], "t string")
    got = [r[0] for r in verdict.select(answers.correctness_verdict(F.col("t"))).collect()]
    assert (got[0]["correct"], got[0]["major_omission"], got[0]["valid"]) == (False, False, True) and got[1]["valid"] is False
    ground = spark.createDataFrame([('{"claims": [{"claim": "a", "supported": true}, {"claim": "b", "supported": "true"}, {"claim": " "}]}',), ('{"claims": []}',)], "t string")
    got = [r[0] for r in ground.select(answers.grounding_verdict(F.col("t"))).collect()]
    assert (got[0]["share"], got[0]["unsupported"]) == (0.5, ["b"]) and got[1]["share"] is None
    clean = spark.createDataFrame([("<thinking>x</thinking> Answer: 42",), ("FAIL TO GENERATE ANS.",)], "t string")
    assert [r[0] for r in clean.select(answers.clean_answer(F.col("t"))).collect()] == ["42", answers.NO_ANSWER]


def test_host_and_urls(spark):
    df = spark.createDataFrame([("https://WWW.Example.org:443/a?b",), ("http://user:pw@x.org/",), ("nothing",)], "u string")
    assert [tuple(r) for r in df.select(ids.host(F.col("u")), ids.safe_url(F.col("u"))).collect()] == [("example.org", True), ("x.org", False), ("", False)]


def test_matryoshka_prefix_is_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0],)], "v array<double>")
    assert df.select(vectors.shorten(F.col("v"), 2)).first()[0] == [0.6, 0.8]
