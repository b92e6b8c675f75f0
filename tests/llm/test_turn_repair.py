import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lorekeep.llm import queries, turn_repair
from tests.llm.helpers import SMALL, by_id
from tests.oracle import compare, connect

PATTERN = re.compile("(s?(ua)+)?")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else v for v in (c, t, r, x))
        kind = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(items):
    """Brute force: (cost, audit, rows) by a table over all rows, places and edits, ties by the audit."""
    best = {("", False): (0, "", ())}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(states):
        for _ in range(3):
            for (place, _), (cost, audit, rows) in list(states.items()):
                new = "a" if place == "u" else "u"
                way = (cost + 5, audit + "I", rows + ({"u": "user", "a": "assistant"}[new] + ":",))
                states[new, False] = min(states.get((new, False), way), way)
        return states

    for role, text, gone, cut in items:
        after = {}
        for (place, _), (cost, audit, rows) in inserted(best).items():
            ways = [(place, (cost + 2, audit + "D", rows))]
            if not gone:
                if role[:1] in step[place]:
                    ways.append((role[:1], (cost + 5 * cut, audit + "K", rows + (f"{role}:{text}",))))
                for new, name in (("u", "user"), ("a", "assistant")):
                    if new in step[place]:
                        ways.append((new, (cost + 1 + 5 * cut, audit + "R", rows + (f"{name}:{text}",))))
            for new, way in ways:
                after[new, False] = min(after.get((new, False), way), way)
        best = after
    return min(v for (place, _), v in inserted(best).items() if place in ("", "a"))


def expected(rows):
    convs = defaultdict(list)
    for r in damage(rows):
        convs[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        seen, items, faults = set(), [], defaultdict(int)
        held = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for _, t, role, text in held:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            items.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[1] for r in held} - {None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        cost, audit, made = cheapest(items)
        assert PATTERN.fullmatch("".join(m[0] for m in made))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(seed, convs, longest):
    random.seed(seed)
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why? ", "a\x1f", "é…", "Done.\t\n"]
    roles = ["user", "assistant"] * 4 + ["system", None, "", "tool", "support"]
    rows = []
    for c in [None, -3, *range(convs)]:
        size = random.choice((1, 2, 3, 5, 8, longest))
        rows += [(c, random.choice((t, t, t, t + 3, None)), random.choice((("user", "assistant")[t % 2], random.choice(roles))), random.choice((f"Text {t}.", random.choice(texts))))
                 for t in range(size)]
    return rows + rows[:7]


def test_search_alone():
    random.seed(5)
    for _ in range(3000):
        items = [(random.choice(("user", "assistant", "system", "tool", "")), "x", random.random() < 0.2, random.random() < 0.3) for _ in range(random.randrange(9))]
        items = [(r, t, g, c and not g) for r, t, g, c in items]
        plain = [(r[:1], g, c) for r, _, g, c in items]
        cost, audit, made = cheapest(items)
        assert turn_repair.search(plain, 0) == (cost, audit)
        assert [f"{r['role']}:{r['text']}" for r in turn_repair.edited([(r, t) for r, t, _, _ in items], audit)] == list(made)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_put_together(monkeypatch, size):
    monkeypatch.setattr(turn_repair, "SEGMENT", size)
    random.seed(size)
    for _ in range(150):
        items = [(random.choice(("user", "assistant", "system", "tool")), "x", random.random() < 0.2, random.random() < 0.2) for _ in range(random.randrange(1, 25))]
        items = [(r, t, g, c and not g) for r, t, g, c in items]
        run = turn_repair.Run(1)
        run.items = [(r[:1], g, c) for r, _, g, c in items]
        assert run.solved() == cheapest(items)[:2]


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_against_brute_force(spark, partitions):
    rows = odd_rows(partitions, 40, 150)
    frame = spark.createDataFrame([(*r, "x", 1, "z", 3) for r in rows],
                                  "conv_id long, turn long, role string, text string, conv string, copies int, said string, seen int")
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = turn_repair.repair(queries.damaged(frame), copies="copies")
        shown = [(r.conv, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                  hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in r.repaired).encode()).hexdigest()) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held[1])
    assert sorted(shown, key=str) == expected(rows)


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_turn_repair"](spark, SMALL).select(COLUMNS).collect()), key=str) == expected(rows)


def test_query_equals_its_sql(spark):
    got = queries.QUERIES["op13_turn_repair"](spark, SMALL)
    cursor = connect(SMALL).execute(queries.ORACLES["op13_turn_repair"])
    assert compare((got.columns, [tuple(r) for r in got.collect()]), ([d[0] for d in cursor.description], cursor.fetchall())) is None


def test_dropped_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, copies int"
    only = turn_repair.repair(spark.createDataFrame([(1, 0, "user", "Gone.", 0), (2, 0, "user", "Hi.", 1), (2, None, "system", "Be.", 1)], schema), copies="copies")
    found = by_id(only, "conv")
    assert tuple(found[1])[1:] == (0, 0, 0, 0, 0, 0, "", []) and (found[2].audit, found[2].cost, found[2].gaps) == ("RR", 2, 0)
    assert turn_repair.repair(spark.createDataFrame([], schema)).collect() == []


def test_long_conversation_is_linear(spark):
    rows = [(1, t, ("user", "user", "assistant")[t % 3], f"Text {t}.") for t in range(3000)]
    found = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 1 and found[0].illegal == 1000 and PATTERN.fullmatch("".join(r.role[0] for r in found[0].repaired))
