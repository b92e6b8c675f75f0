"""Escaping, reply trees against a recursive walk, and the defined cases."""

from collections import defaultdict
import random

from hypothesis import given, settings, strategies as st

from lorekeep.llm import chat

SCHEMA = "conv long, node long, parent long, score double, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", ">", "a", "\n", "[", "s", "é"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


def read(spark, messages, keep=1):
    frame = spark.createDataFrame(messages, SCHEMA)
    return {(r.conv, r.branch): ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_back(chat.formatted(frame, keep)).collect()}


def test_trees_against_a_recursive_walk(spark):
    rnd = random.Random(1)
    messages = []
    for conv in range(12):
        for node in range(rnd.randint(1, 14)):
            parent = rnd.choice([None, *range(node), 99]) if node and rnd.random() < 0.9 else None
            messages.append((conv, node, parent, rnd.choice([None, 0.0, 1.0, 0.5]), rnd.choice(["user", "assistant"]), f"t{conv}.{node} {chat.TURN}"))
    messages += [(50, i, i - 1 if i else None, 0.0, "user" if i % 2 else "assistant", f"deep {i}") for i in range(70)]
    messages += [(60, 1, 2, 0.0, "user", "loop"), (60, 2, 1, 0.0, "user", "loop"), (60, 3, None, 0.0, "user", "root")]
    expected = {}
    by = defaultdict(dict)
    for m in messages:
        by[m[0]][m[1]] = m
    for conv, nodes in by.items():
        parents = {m[2] for m in nodes.values()}
        paths = []
        for leaf in (n for n in nodes if n not in parents):
            path, at = [], leaf
            while at is not None and at in nodes:
                path.append(nodes[at])
                at = nodes[at][2]
            paths.append((-sum(m[3] or 0 for m in path), -len(path), leaf, path[::-1]))
        for branch, (*_, path) in enumerate(sorted(paths)[:3], 1):
            expected[conv, branch] = ([(m[4], m[5]) for m in path], "".join(m[5] for m in path if m[4] == "assistant"))
    assert read(spark, messages, keep=3) == expected


def test_flat_conversations_and_defined_cases(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "b", 0), (None, 0, "user", "n", 1), (2, None, None, "\\<|end|>\n", 5),
                                  (3, 0, "odd\nrole<|turn|>", "x" * 50_000, 5)], "conv_id long, turn long, role string, text string, node int")
    got = {r.conv: ([(t.role, t.text) for t in r.turns], r.loss_text, r.formatted_chars) for r in chat.read_back(chat.formatted(chat.chain(rows))).collect()}
    assert got[1][:2] == ([("user", ""), ("assistant", "b"), ("assistant", "b")], "bb")
    assert got[None][0] == [("user", "n")] and got[2][0] == [("", "\\<|end|>\n")] and got[3][0] == [("odd\nrole<|turn|>", "x" * 50_000)]
    assert chat.formatted(chat.chain(rows.where("turn = 9"))).collect() == []
