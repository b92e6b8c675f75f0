"""The registered queries on the smallest tables: against SQL where there is one, and the pipeline step by step."""

import random
import sys

import pytest

import corpus_pipeline
from lorekeep.llm import queries
from tests.llm.helpers import SMALL, TESTDATA, by_id
from tests.llm.test_ngram_join import components
from tests.oracle import compare, connect

KEYS = {"op6_urls": ("pages", "page_id"), "op7_chat": ("conversations", "conv_id"), "op12_turn_trie": ("conversations", "conv_id"), "op13_turn_repair": ("conversations", "conv_id")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name in queries.ORACLES:
        cursor = connect(SMALL).execute(queries.ORACLES[name])
        assert compare((df.columns, rows), ([d[0] for d in cursor.description], cursor.fetchall())) is None
    if name == "op12_turn_trie":  # its rows are nodes, not conversations
        return
    source, key = KEYS.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select(key).collect()}
    assert {r[df.columns.index(key)] for r in rows} - {-1} == ids
    if name not in ("op10_packing",):
        assert len(rows) == len(ids) + (name == "op7_chat")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_against_its_steps(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
    got = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    toxic = by_id(queries.QUERIES["op5_toxicity"](spark, SMALL))
    clean = {i: t for i, t in texts.items() if not toxic[i].predicted}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id in (" + ",".join(map(str, clean)) + ")")
    known = by_id(corpus_pipeline.drop_unidentified(spark, docs, SMALL))
    assert set(known) == {i for i, t in clean.items() if any(c.isalpha() for c in t or "")}
    assert got == set(components([(i, known[i].text) for i in sorted(known)]).values())


def test_off_language_texts_go_and_clean_ones_stay(spark):
    rnd = random.Random(4)
    known = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    clean = [r.text for r in known.where("length(text) > 600").orderBy("doc_id").limit(100).collect()]
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя", "".join(map(chr, range(0x4E00, 0x5800)))]
    off = [" ".join("".join(rnd.choices(a, k=rnd.randint(2, 9))) for _ in range(n)) for a in alphabets for n in (20, 200, 1000) for _ in range(20)]
    off += ["".join(rnd.sample(t, len(t))) for t in clean]
    texts = [*clean, *(t[:600] for t in clean), *(" ".join(t.split()[:3]) for t in clean), *((t.split()[5] + " ") * 300 for t in clean), *off]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_unidentified(spark, docs, f"{TESTDATA}/sf0.01").collect()}
    gone = [len(set(range(i, i + 100)) - kept) for i in (0, 100, 200, 300)]
    assert gone[:2] == [0, 0] and max(gone[2:]) <= 3
    assert sum(i >= 400 for i in kept) <= 0.03 * len(off)


def test_stages_on_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None, 0.5), (2, "", "en", "s", 0, 0.5), (3, "The same words of one text here", "en", "s", 3, 0.5),
                                 (3, "The same words of one text here", "en", "s", 3, 0.5), (4, "the same words of one text here", None, None, None, 0.5),
                                 (None, "Without an id but with words", "en", "s", 3, 0.5)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    rest = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rest = stage(spark, rest, SMALL)
        assert rest.columns == corpus_pipeline.COLUMNS, name
    assert sorted(r.doc_id or 0 for r in rest.collect()) == [0, 3]
    assert corpus_pipeline.pack(spark, odd, SMALL).count() == 6
    empty = odd.where("doc_id = 9")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).collect() == []


def test_entry_works_without_the_subpackage(monkeypatch):
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    for name in [m for m in sys.modules if m.startswith("lorekeep.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lorekeep.llm", None)
    import __spark_entry__ as entry
    assert entry.llm is None and entry.corpus_pipeline is None and len(entry.queries()) > 90 and "hybrid_search" in entry.oracle_sql()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
