"""Components of the shingle join against brute force over all pairs, and its defined cases."""

import random
import re

import numpy as np
import pytest

from lorekeep.llm import ngram_join
from tests.llm.helpers import SMALL, by_id, docs, words


def shingle_set(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1:]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i in parent}


def check(spark, rows):
    got = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t)) for _, t in rows)


def variants(count, length, most_edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(length)]
    for _ in range(count):
        text = list(base)
        for _ in range(rnd.randint(0, most_edits)):
            text[rnd.randrange(length)] = f"e{rnd.randrange(10 ** 6)}"
        yield " ".join(text[:length - rnd.randint(0, most_edits)])


def test_groups_of_all_sizes(spark):
    """Rare and frequent signatures: pairs, a group far beyond the crowd limit with links and near misses, one common passage."""
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [*variants(90, 60, 3, 1), *variants(40, 25, 2, 2), *variants(5, 400, 15, 3)]
    texts += [passage + " " + " ".join(f"u{rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(3, 60))) for _ in range(60)]
    rnd.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_second_pass_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    check(spark, list(enumerate([*variants(30, 40, 4, 7), *variants(20, 12, 1, 8)])))


def test_defined_cases(spark):
    long = " ".join(f"l{i}" for i in range(3000))
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " end"), (8, long + " end"),
                  (None, long), (9, "a b c d e"), (10, "A b c d e"), (11, None), (12, "É b c d e"), (13, "é b c d e")])


def test_empty_table(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).collect() == []


def test_whole_small_table(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = by_id(ngram_join.near_duplicates(frame))
    assert {i: r.component_id for i, r in got.items()} == components(rows)


@pytest.mark.parametrize("sizes", [(4, 5), (20, 24), (99, 100), (400, 500)])
def test_similar_sets_share_a_signature(sizes):
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = sizes
        shared = next(s for s in range(a + 1) if 100 * s >= 80 * (a + b - s))
        pool = rng.integers(0, 2 ** 64, a + b - shared, dtype=np.uint64)
        left, right = np.sort(pool[:a]), np.sort(pool[len(pool) - b:])
        sig, text, *_ = ngram_join.signatures(np.concatenate([left, right]), np.array([0, a, a + b]), 80)
        assert set(sig[text == 0].tolist()) & set(sig[text == 1].tolist())


def test_entries_survive_packing():
    rng = np.random.default_rng(9)
    for count, span, parts in ((1, 5, 3), (40, 8, 300), (3000, 900, 70_000), (700, 2, 10), (50, 2**62, 9)):
        entry = np.zeros(count, ngram_join.ENTRY)
        entry["sig"] = rng.integers(0, 2**64, count, dtype=np.uint64)
        entry["doc"] = np.sort(rng.integers(-span, span, count))
        entry["set"] = entry["doc"] * 7919
        entry["part"], entry["hot"] = rng.integers(0, parts, count), rng.integers(0, 2, count)
        got = ngram_join._unpacked(ngram_join._packed(entry))
        assert (got["sig"] == entry["sig"] >> np.uint64(24)).all()
        assert all((got[c] == entry[c]).all() for c in ("doc", "part", "hot"))
        assert (got["set"] == entry["set"] & ((1 << 48) - 1)).all()
