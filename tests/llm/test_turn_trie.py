import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import queries, turn_trie
from tests.llm.helpers import SMALL
from tests.oracle import compare, connect


def said(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def rebuild(rows):
    """Brute force of the contract's rebuilding: {conv: [(role, text)]}."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", said(r[2], r[3])[:32])):
        own[c].append((r or "", x or ""))
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[:h] + own[c][h:] for c, h in heads.items()}


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        childless = [p for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in members)]
        ends = ",".join(map(str, sorted(c for c in convs if len(conversations[c]) == len(path))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
                    sum(q[:len(path)] == path and len(q) == len(path) + 1 for q in members), len(childless),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), ends))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def odd_rows(seed, convs=120):
    random.seed(seed)
    rows = []
    for c in [*random.sample(range(0, 700), convs), 0, 100, 300]:
        for t in range(random.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, random.choice((None, 0, t, t)), random.choice(("user", "assistant", None, "")), random.choice(("a", "bb", "", None, "ccc"))))
    return rows + rows[:4] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("cells", [1, 7, 60, 1 << 21])
def test_against_brute_force(spark, monkeypatch, tmp_path, cells):
    rows = odd_rows(cells)
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, conv string, turns string, ids string")
    monkeypatch.setattr(turn_trie, "CELLS", cells)
    made = turn_trie.regrafted(turn_trie.turns(frame), 100, F.crc32(F.col("conv").cast("string")) % 6)
    assert order(turn_trie.trie(made).collect()) == order(brute(rebuild(rows)))


def test_chunks_alone_meet_again(spark, monkeypatch):
    """Copies, prefixes of each other and turnless conversations over chunks of two cells each."""
    texts = ["", "a", "a", "a", "ab", "abc", "abc", "b", "", "bc", "abc", "abc", "abcd" * 9]
    conversations = {i: [("user", x) for x in t] for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, [(n, "user", bytes.fromhex(said("user", x)[:32]), 1) for n, x in enumerate(t)]) for i, t in enumerate(texts)],
                                  "conv long, turns array<struct<turn:long,role:string,id:binary,chars:int>>")
    for cells in (1, 2, 5, 40):
        monkeypatch.setattr(turn_trie, "CELLS", cells)
        monkeypatch.setattr(turn_trie, "ROWS", max(1, cells // 2))
        assert order(turn_trie.trie(frame).collect()) == order(brute(conversations))
    assert turn_trie.trie(frame.where("conv < 0")).collect() == []
    only_empty = turn_trie.trie(frame.where("size(turns) = 0")).collect()
    assert [tuple(r) for r in only_empty] == [(0, 0, None, 2, 0, 1, 0, "0,8")]


def test_hot_conversation_is_spread_over_chunks():
    sizes, ids = np.full(1000, 3, np.int64), np.frombuffer(bytes(range(48)) * 1000, np.uint8)
    columns = turn_trie.chunk_nodes(5, np.arange(1000), sizes, ids, np.ones(3000, np.int64))
    assert columns[4] == [0, 1, 2, 3] and columns[6] == [1000] * 4 and columns[11] == [True] * 4


def test_query_equals_its_sql(spark):
    got = queries.QUERIES["op12_turn_trie"](spark, SMALL)
    cursor = connect(SMALL).execute(queries.ORACLES["op12_turn_trie"])
    assert compare((got.columns, [tuple(r) for r in got.collect()]), ([d[0] for d in cursor.description], cursor.fetchall())) is None
