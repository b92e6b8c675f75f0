"""The language stage of the pipeline learns from every labelled row."""

import pytest

from lorekeep.llm import language

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_least_cosines_and_prototypes_come_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    rows = [(i, f"the cat and the dog number {'x' * (i % 7)}", "en", "s", 1) for i in range(1200)] + [(i, f"der hund und die katze {'y' * (i % 5)}", "de", "s", 1) for i in range(1200, 1230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    def sampled(*a, **k):
        raise AssertionError("a sample was drawn")
    monkeypatch.setattr(language, "bounded_sample", sampled)
    kept = corpus_pipeline.drop_unidentified(spark, docs, str(tmp_path))
    assert 0 < kept.count() <= len(rows)


def test_least_cosines_spare_nearly_all_labelled_texts(spark):
    prose = "the quick brown fox jumps over the lazy dog and runs along the river bank until the evening comes "
    rows = [(i, prose * 3 + f"{chr(97 + i % 26)}", "en") for i in range(700)] + [(i, "zwei hunde laufen am fluss entlang bis der abend kommt und die nacht " * 4, "de") for i in range(700, 1400)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(known, "text", "lang")
    least = language.least_cosines(known, model)
    assert len(least) == language.LEVELS and (least >= 0).all()
    assert language.predict(known, model, least=least).where("lang_pred = 'und'").count() <= 0.01 * len(rows)
