"""Sentence pieces, packing and fingerprints: the libraries, naive versions and the defined cases."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from lorekeep.llm import fingerprints, packing, sentencepieces
from lorekeep.llm.wordtable import WordTable
from tests.llm.helpers import SMALL, by_id, docs

xxhash = pytest.importorskip("xxhash")
sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [None, "", " ", "  two  blanks ", "Hello world. Hello\nworld!", "same", "same", "▁ marks ▁▁x", "\x00\x1c  é字😀 ẞ <|endoftext|>", "It's 12'3 we'reİ ﬁ",
         "long " * 6000, "x" * 9000, "ünï cödé " * 50]


def rows(spark):
    return docs(spark, [*enumerate(TEXTS), (None, "no id")])


def random_texts(seed, many):
    rnd = random.Random(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz    \n\t.,'0123456789ABCéüñ") + ["字", "😀", "▁", "ẞ", "\x00", "ק", "م", "ф", "  ", "<|", " ", "İ", "ſ", "Ɓ", "Σ"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(many)]


# --- sentence pieces ------------------------------------------------------------------------------------------------------

def test_pieces_match_the_library(spark):
    model, library = path("piece_bpe_32k.model"), sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    coded = by_id(sentencepieces.decode(sentencepieces.encode(rows(spark), model), model))
    for i, text in enumerate(TEXTS):
        assert coded[i].ids == [*library.encode(text or ""), library.eos_id()]
        assert coded[i].text == library.decode(coded[i].ids)
    vocabulary = sentencepieces.vocabulary_of(model)
    some = random_texts(1, 1500) + [library.decode([random.Random(s).randrange(259, 32000) for _ in range(9)]) for s in range(500)]
    for text, ids in zip(some, vocabulary.encode_all(pa.array(some))):
        assert ids.tolist() == [*library.encode(text), library.eos_id()], text
    rnd = random.Random(2)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randrange(259), rnd.randrange(32000), 35, 29871]) for _ in range(rnd.randint(0, 8))]
        assert vocabulary.decode(ids) == library.decode(ids), ids
    assert sentencepieces.encode(docs(spark, []), model).collect() == []


def test_word_table_survives_overflow():
    table, asked = WordTable("<i4", limit=8), []
    learn = lambda found: (asked.extend(found), [np.arange(len(w), dtype=np.int32) + w[0] for w in found])[1]
    rnd = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 12))).encode()
        data = np.frombuffer(text, np.uint8)
        starts = np.array([0, *(i + 1 for i, c in enumerate(text) if c == 32)])
        ends = np.array([*(i for i, c in enumerate(text) if c == 32), len(text)])
        ids, sizes = table.ids(data, starts, ends, learn)
        assert ids.tolist() == [w[0] + k for w in text.split() for k in range(len(w))] and sizes.tolist() == [len(w) for w in text.split()]
    assert len(asked) > 8


# --- packing --------------------------------------------------------------------------------------------------------------

def naive_best_fit(lengths, window):
    room, places = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        tight = min((r for r, _ in fits), default=None)
        if tight is None:
            room.append(window - lengths[i])
            continue
        room[next(k for r, k in fits if r == tight)] -= lengths[i]
    return sorted(room)


def test_best_fit_against_a_scan_over_all_windows():
    rnd = random.Random(1)
    for _ in range(60):
        window = rnd.choice([7, 16, 100])
        lengths = [rnd.randint(1, window) for _ in range(rnd.randint(0, 80))]
        places, offsets, opened = packing.best_fit(lengths, window)
        filled = [sum(n for n, p in zip(lengths, places) if p == k) for k in range(opened)]
        assert sorted(window - f for f in filled) == naive_best_fit(lengths, window)
        for k in range(opened):
            inside = sorted((o, n) for n, p, o in zip(lengths, places, offsets) if p == k)
            assert [o for o, _ in inside] == [sum(n for _, n in inside[:j]) for j in range(len(inside))]


def test_packed_sequences(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = packing.pack(rows(spark).repartition(3), path("word_bpe_49k.json")).collect()
    for i, text in enumerate(TEXTS):
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = [x for r in parts for x in struct.unpack(f"<{r.length}I", r.ids)]
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and {r.doc_tokens for r in parts} == {len(ids)}
    for sequence in {r.sequence_id for r in got}:
        inside = sorted((r.offset, r.length) for r in got if r.sequence_id == sequence)
        assert sum(n for _, n in inside) <= 2048 and [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
    assert packing.pack(docs(spark, []), path("word_bpe_49k.json")).collect() == []


def test_word_tokens_match_the_library():
    tokens = packing.word_tokens(path("word_bpe_49k.json"))
    some = random_texts(3, 2000)
    for text, ids in zip(some, tokens.ids(pa.array(some), 1)):
        assert ids.tolist() == [*tokens.library.encode(text, add_special_tokens=False).ids, 1], text


def test_rounds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUND_PIECES", 5)
    got = packing.pack(docs(spark, [(i, "word " * (i * 37 % 500)) for i in range(60)]).coalesce(1), path("word_bpe_49k.json")).collect()
    assert sorted({r.doc_id for r in got}) == list(range(60))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 and len({o for o, _ in x}) == len(x) for x in by.values())


# --- fingerprints ---------------------------------------------------------------------------------------------------------

def chained(values, kinds):
    seed = 42
    for value, kind in zip(values, kinds):
        data = value.encode() if kind == "s" else struct.pack("<q", value) if kind == "q" else struct.pack("<i", value)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def naive_fingerprint(text):
    import re
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % fingerprints.TOKEN, text or "")
    place = fingerprints.PLACE
    runs = [chained([tokens[i + j] if i + j < len(tokens) else "" for j in range(3)], "sss") for i in range(max(1, len(tokens) - 2))] if tokens else []
    seen, elements = {}, []
    for i, h in enumerate(runs):
        high = h >> fingerprints.PLACE_BITS
        elements.append((chained([high, seen.get(high, 0)], "qi") & ~place) | i)
        seen[high] = seen.get(high, 0) + 1
    bins = {}
    for x in sorted(elements):
        bins.setdefault(x >> 58, []).append(x)
    out = []
    for b in sorted(bins):
        picked = sorted((x & place, x >> fingerprints.PLACE_BITS) for x in bins[b][:2])
        out.append(f"{(b + 32) << 32 | chained([h for _, h in picked], 'q' * len(picked)) & 0xFFFFFFFF:010x}")
    return "-".join(out)


def test_fingerprints_against_brute_force(spark):
    rnd = random.Random(8)
    texts = [*TEXTS, *(" ".join(rnd.choice(["a", "b", "cc", "dé", "e" * 40]) for _ in range(rnd.randint(0, 200))) for _ in range(60))]
    got = by_id(fingerprints.edited(docs(spark, list(enumerate(texts))), part_rows=7))
    for i, text in enumerate(texts):
        own, following = text or "", texts[i - 1] or ""  # descending ids: the next of 0 is the last
        half = len(own) // 2
        assert got[i].n_chars == len(own) and got[i].edited == own[:len(own) - half] + following[:half]
        assert got[i].fingerprint == naive_fingerprint(own) and got[i].edited_fingerprint == naive_fingerprint(got[i].edited)
        for shown, other in ((got[i].near_edited, got[i].edited), (got[i].near_next, following)):
            a, b = (set(filter(None, naive_fingerprint(t).split("-"))) for t in (own, other))
            filled = {x[:2] for x in a | b}
            assert shown == pytest.approx(len(a & b) / len(filled) if filled else 1.0, abs=1e-6)


def test_fingerprints_see_order():
    a, b = naive_fingerprint(" ".join(f"w{i}" for i in range(400))), naive_fingerprint(" ".join(f"w{i}" for i in [*range(200, 400), *range(200)]))
    assert 0 < len(set(a.split("-")) & set(b.split("-"))) < 64


def test_texts_without_blanks_follow_the_edit_distance(spark):
    rnd = random.Random(5)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(2000)), "".join(rnd.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(3000)),
             "😀字" + "".join(chr(rnd.randrange(0x1F300, 0x1F600)) for _ in range(900))]
    rows = [(i, text, changed) for i, text in enumerate(texts) for changed in ("字" + text, text[:700] + "x" + text[700:], text[:500] + text[501:])]
    rows += [(9, texts[0], texts[1]), (9, texts[0], texts[0][1000:] + texts[0][:1000])]
    frame = spark.createDataFrame(rows, "i long, a string, b string")
    got = fingerprints.sketched(fingerprints.sketched(frame, "a", "x"), "b", "y").select(fingerprints.likeness("x", "y")).collect()
    assert all(r[0] > 0.8 for r in got[:-2]) and got[-2][0] < 0.1 and 0 < got[-1][0] < 1
    runs = spark.createDataFrame([(t,) for t in [*texts, "e" * 40, "x" * 17]], "t string").select("t", fingerprints.cuts(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(1 <= len(x) <= fingerprints.TOKEN for x in r.c) for r in runs)


def test_next_rows_with_ties_and_missing_ids(spark):
    frame = spark.createDataFrame([(3, "a"), (3, "a"), (2, "b"), (None, "n"), (1, None), (None, "m")], "doc_id long, text string")
    got = fingerprints.edited(frame, part_rows=2).collect()
    assert len(got) == 6 and all(r.n_chars == (1 if r.doc_id != 1 else 0) for r in got)
    single = fingerprints.edited(frame.where("doc_id = 2")).collect()
    assert single[0].near_next == 1.0 and single[0].edited == "b"
    assert fingerprints.edited(frame.where("doc_id = 9")).collect() == []


def test_whole_small_table_keeps_equal_texts_equal(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = fingerprints.edited(frame).join(frame.select("doc_id", F.col("text").alias("t")), "doc_id").groupBy("t").agg(F.count_distinct("fingerprint").alias("n")).where("n > 1")
    assert got.count() == 0
