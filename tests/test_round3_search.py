"""Searches read the collection once and make no pairs of queries and documents."""

import math
import random
import re

from lorekeep.functions.text import BM25_STOP_WORDS
from lorekeep.operators import lexical


def _collection(spark, n=60):
    random.seed(7)
    vocabulary = ["ruby", "opal", "jade", "onyx", "pearl", "the", "amber"]
    texts = {i: " ".join(random.choice(vocabulary) for _ in range(random.randint(1, 9))) for i in range(n)}
    texts[n], texts[n + 1] = texts[3], ""
    asked = {"q1": "ruby opal", "q2": "jade of pearl onyx opal", "q3": "nothing here", "q4": "the"}
    return texts, asked, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(asked.items()), "query_id string, text string")


def _expected(texts, asked):
    tokens = {d: [w for w in re.findall("[a-z0-9]+", t.lower()) if w not in BM25_STOP_WORDS] for d, t in texts.items()}
    average = sum(map(len, tokens.values())) / len(tokens)
    df = {w: sum(w in t for t in tokens.values()) for t in tokens.values() for w in t}
    out = {}
    for q, text in asked.items():
        terms = {w for w in re.findall("[a-z0-9]+", text.lower()) if w not in BM25_STOP_WORDS}
        for d, t in tokens.items():
            score = sum(math.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / average))
                        for w in terms if w in t)
            if score:
                out[q, d] = score
    return out


def test_bm25_reads_the_collection_once_and_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 20)
    texts, asked, docs, queries = _collection(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    got = lexical.bm25_topk(docs.mapInPandas(counted, docs.schema), queries, 8).collect()
    assert read.value == len(texts)
    expected = _expected(texts, asked)
    for q in asked:
        best = sorted(((-round(s, 9), d) for (x, d), s in expected.items() if x == q))[:8]
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.doc_id for r in found] == [d for _, d in best] and [r.rank for r in found] == list(range(1, len(best) + 1))
        assert all(abs(r.score - expected[q, r.doc_id]) < 1e-12 for r in found)
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in lexical.bm25_scores(docs, queries).collect()} == {k: round(s, 9) for k, s in expected.items()}


def test_hard_negatives_leave_out_gold_and_break_ties_by_text(spark):
    texts, asked, docs, queries = _collection(spark)
    gold = spark.createDataFrame([("q1", 3), ("q1", 5), ("q2", 60), ("q9", 1)], "query_id string, doc_id long")
    got = lexical.hard_negatives(docs, queries, gold, 6).collect()
    apart = {(r.query_id, r.doc_id) for r in gold.collect()}
    for q in asked:
        best = sorted(((round(s, 9), str(d), d) for (x, d), s in _expected(texts, asked).items() if x == q and (x, d) not in apart), reverse=True)[:6]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [d for _, _, d in best]
