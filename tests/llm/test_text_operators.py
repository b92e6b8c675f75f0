"""Language, quality, licenses and toxicity: brute force, held-out accuracy and the defined cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import language, licenses, quality, queries, toxicity
from lorekeep.llm.arrays import FOLD_CASE, flat, word_bounds
from tests.llm.helpers import TESTDATA, by_id, docs, words

CASES = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! 123"), (5, "Hello there friend"), (5, "Hello there friend"), (None, "Hello"), (6, "ßİ̇ 字 😀 " * 300),
         (7, "a " * 40_000)]


# --- language -------------------------------------------------------------------------------------------------------------

def plain_vector(text, dimensions, gram, seed):
    """The same bundle, letter by letter."""
    cleaned = re.sub(r"[^\W\d_]", lambda m: m[0] if m[0].isalpha() else " ", text.lower())
    cleaned = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in cleaned)) + " "
    out = np.zeros(dimensions)
    if not any(c.isalpha() for c in cleaned):
        return out
    codes = sorted(set(map(ord, cleaned)))
    table = dict(zip(codes, language.letter_vectors(np.array(codes), dimensions, seed)))
    for i in range(len(cleaned) - gram + 1):
        bound = np.ones(dimensions)
        for j in range(gram):
            bound *= np.roll(table[ord(cleaned[i + j])], gram - 1 - j)
        out += bound
    return out


def test_vectors_match_the_definition():
    texts = ["Ab c", "", "é1é ab?!  x", "123", "the cat", "字が 語", " lead", "trail "]
    got = language.text_vectors(texts, 128, 3, 7)
    for text, vector in zip(texts, got):
        assert np.allclose(vector, plain_vector(text, 128, 3, 7)), text


def test_language_cases(spark):
    known = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)], "doc_id long, text string, lang string")
    model = language.learn(known, "text", "lang")
    got = language.predict(docs(spark, CASES), model, keep=("doc_id", "score")).collect()
    assert len(got) == len(CASES) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)} == {"und"}
    assert all(0 <= r.score <= 1 and isinstance(r.score, float) for r in got)
    assert by_id(language.predict(known, model))[1].lang_pred == "de"
    nothing = language.learn(known.where("lang is null"), "text", "lang")
    assert {r.lang_pred for r in language.predict(docs(spark, CASES), nothing).collect()} == {"und"}
    assert language.predict(docs(spark, []), model).collect() == []


def test_language_held_out_accuracy(spark):
    folder = f"{TESTDATA}/sf0.01"
    got = by_id(queries.QUERIES["op2_language"](spark, folder))
    truth = by_id(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"))
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].lang_pred == truth[i].lang for i in held if truth[i].lang]) > 0.97


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(400)] + [(1000, "der hund und die katze", "de")] + [(None, "le chat et le chien", "fr")] * 30
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_sample(known, sample_rows=5)
    assert model[0] == ["de", "en", "fr"]
    sample = language.bounded_sample(known, "doc_id", "lang", 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sample if r.lang != "en"} == {"de": 1, "fr": 30}
    assert 5 < sum(r["count"] for r in sample if r.lang == "en") < 50


# --- quality --------------------------------------------------------------------------------------------------------------

def counts(text):
    found, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    runs = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    many = Counter(runs)
    covered = {i + j for i, r in enumerate(runs) if many[r] > 1 for j in range(5)}
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [*CASES, *((100 + i, "".join(rnd.choice(["a ", "b ", "cc ", "d\n", "# ", " ", "é\t", "\x0b"]) for _ in range(rnd.randint(0, 60)))) for i in range(150))]
    got = quality.judge(docs(spark, rows)).collect()
    shown = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert shown == sorted((i or 0, *counts(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_verdict_does_not_depend_on_the_order(spark, monkeypatch):
    rows = docs(spark, [(i, t) for i, t in enumerate(["A plain sentence with more than ten words in it, all of them clean.", "WHAT!! IS!! THIS!! LOUD!! TEXT!! HERE!! WITH!! MANY!! MARKS!! IN!! IT!!",
                                                     "one | two | three | four | five | six | seven | eight | nine | ten |", " ".join(f"{n}23456" for n in range(30))])])
    first = by_id(quality.judge(rows))
    assert [first[i].kept for i in range(4)] == [True, False, False, False]
    monkeypatch.setattr(quality, "cascade_order", lambda counts, listed: listed[::-1])
    second = by_id(quality.judge(rows))
    assert {i: r.kept for i, r in first.items()} == {i: r.kept for i, r in second.items()}


def test_cascade_puts_rejections_per_cost_first(spark):
    rows = spark.createDataFrame([(False, 1), (False, 2), (True, 3)], "base_failed boolean, x int")
    rule = lambda name, cost, rejects: quality.Rule(name, F.lit(cost), rejects)
    listed = [rule("rare", 1, F.col("x") == 2), rule("dear", 10, F.col("x") > 0), rule("good", 1, F.col("x") > 0), rule("never", 1, F.col("x") == 3)]
    assert [r.name for r in quality.cascade_order(rows, listed)] == ["good", "rare", "dear", "never"]
    assert quality.cascade_order(rows.where("x > 9"), listed) == listed
    assert quality.judge(docs(spark, [])).collect() == []


# --- licenses -------------------------------------------------------------------------------------------------------------

def expansions(parsed):
    """Texts that a title's pattern fits: every branch, options with and without, the first and last of each set."""
    out = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "IN":
            first = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
            more = sorted({first[0], first[-1]})
        elif kind == "BRANCH":
            more = [x for branch in value[1] for x in expansions(branch)]
        elif kind == "SUBPATTERN":
            more = expansions(value[3])
        elif kind == "MAX_REPEAT":
            more = [x for x in ([""] if value[0] == 0 else [])] + expansions(value[2])
        else:
            assert kind in ("AT", "ASSERT_NOT"), kind
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_every_title_and_form_passes_the_gate(spark):
    scanner = licenses.Scanner()
    for label, _, title, _ in licenses.LICENSES:
        patterns = {form: re.compile(p.replace("T", title)) for form, _, _, p in licenses.FORMS if "T" in p}
        for shown in expansions(re._parser.parse(title)):
            for text in (shown, f"licensed under {shown}.", f"released under the {shown}.", f"under the terms of {shown}", f"{shown} or later", f"see {shown}", f"copy of the {shown}"):
                fitting = {form for form, pattern in patterns.items() if pattern.search(text)}
                gates = {k for _, k in scanner.keywords.iter(text)}
                assert fitting <= {s[1] for k in gates for s in scanner.gated[k] if s[0] == label}, (label, text)
    cases = [(1, "This library is released under the 3-clause BSD."), (2, "Distributed under the terms of the modified BSD"), (3, "MIT No Attribution"),
             (4, "the Expat license"), (5, "GNU Library General Public License")]
    got = by_id(licenses.scan(docs(spark, cases)))
    shown = [[(d.label, d.form) for d in got[i].detections] for i in range(1, 6)]
    assert shown == [[("bsd-3-clause", "release")], [("bsd-3-clause", "release")], [("mit-0", "title")], [("mit", "title")], [("lgpl", "title")]]


def test_license_phrases_and_labels(spark):
    rows = [*CASES, (10, "MIT License. The mit, license; mit\nlicense"), (11, "submit license mit licenses mit_license"), (12, "Licensed under the Apache License, Version 2.0."),
            (13, "GNU General Public License, version 3 or later"), (14, "SPDX-License-Identifier: LGPL-2.1-or-later"), (15, "general  public license" * 2)]
    got = by_id(licenses.scan(docs(spark, rows)))
    for i, text in rows:
        if i is None:
            continue
        found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(found)) if found[k:k + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(found) and [(p.word, p.label) for p in got[i].places] == places, i
    assert [d.label for d in got[12].detections] == ["apache-2.0"] and got[12].detections[0].form == "grant"
    assert [d.label for d in got[13].detections] == ["gpl-3.0"] and [d.label for d in got[14].detections] == ["lgpl-2.1"]
    assert len(got[10].places) == 3 and got[2].detections == [] == got[11].places[1:]
    assert licenses.scan(docs(spark, [])).collect() == []


def test_suppression_against_all_pairs():
    rnd = random.Random(3)
    for _ in range(300):
        spans = list({(a, a + rnd.randint(1, 8), rnd.randint(1, 3), f"l{rnd.randint(0, 2)}") for a in (rnd.randint(0, 15) for _ in range(rnd.randint(0, 9)))})
        order = sorted(spans, key=lambda s: (s[0], -s[1], -s[2], s[3]))
        inside = [s for k, s in enumerate(order) if not any(o[1] >= s[1] and o[2] >= s[2] for o in order[:k])]
        left = [s for s in inside if not any(o[0] >= s[0] and o[1] <= s[1] and o[2] > s[2] for o in inside if o is not s)]
        assert sorted(licenses.suppressed(spans)) == sorted(left)


def test_there_are_hundreds_of_signatures():
    assert sum(map(len, licenses.Scanner().gated.values())) > 300


# --- toxicity -------------------------------------------------------------------------------------------------------------

def test_score_is_the_softmax_of_averaged_embeddings(spark):
    rng = np.random.default_rng(4)
    model = (rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIMENSIONS)).astype("f4"), rng.normal(0, 1, (toxicity.DIMENSIONS, 2)).astype("f4"), rng.normal(0, 1, 2).astype("f4"))
    texts = ["An idiot, an IDIOT and a very long sentence that goes on for more than sixteen words, so that it has two windows", "x", "é字 ab"]
    got = by_id(toxicity.score(docs(spark, list(enumerate(texts))), model))
    for i, text in enumerate(texts):
        data, offsets = flat(pa.array([text]))
        data = FOLD_CASE[data]
        starts, ends, _ = word_bounds(data, offsets, toxicity.LETTERS)
        spans = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        best = -math.inf
        for low in range(0, len(spans), toxicity.WINDOW):
            vectors = []
            for word in dict.fromkeys(spans[low:low + toxicity.WINDOW]):
                flat_word = np.frombuffer(word, np.uint8)
                buckets, _ = toxicity.word_features(*toxicity.marked_words(flat_word, np.array([0]), np.array([len(word)])))
                assert len(buckets) == 1 + sum(max(0, len(word) + 2 - n + 1) for n in toxicity.GRAMS)
                vectors.append(model[0][buckets].mean(axis=0))
            logits = np.sum(vectors, axis=0) / toxicity.WINDOW @ model[1] + model[2]
            best = max(best, logits[1] - logits[0])
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-best)), abs=2e-5)


def test_toxicity_learns_words_and_misspellings(spark):
    rnd = random.Random(6)
    plain = lambda n: " ".join("".join(rnd.choice("aeinrst") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = plain(40) + (" you blockhead " if bad else " ") + plain(rnd.randint(0, 60))
        rows.append((i, text))
        labels.append((i, int(bad)))
    label_table = spark.createDataFrame([*labels, (1, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, rows), label_table)
    probe = [(1, plain(200)), (2, plain(150) + " you blockheads " + plain(150)), (3, plain(30) + " you blokhead"), *[(10 + i, t) for i, (_, t) in enumerate(CASES)]]
    got = by_id(toxicity.score(docs(spark, probe), model))
    assert got[1].score < 0.5 < got[2].score and got[3].score > 0.5
    assert got[10].score == got[11].score == got[12].score == 0
    assert toxicity.learn(docs(spark, rows), label_table.where("toxic = 0")) is None
    assert toxicity.learn(docs(spark, [(0, "..."), (1, " "), (2, None)]), spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score(docs(spark, CASES), None).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).collect() == []
