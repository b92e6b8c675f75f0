import random

import numpy as np

from lorekeep.operators import reuse


def brute(rows, window, threshold):
    out = {}
    for i, scope, at, key, vec in rows:
        best = None
        for j, other, then, same, near in rows:
            if other != scope or at - then > window or (then, j) >= (at, i):
                continue
            a, b = np.array(vec or []), np.array(near or [])
            like = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if len(a) == len(b) and np.any(a) and np.any(b) else 0.0
            like = 1.0 if key is not None and key == same else like
            if like >= threshold:
                best = max(best or (then, j, like), (then, j, like))
        out[i] = best
    return out


def test_latest_match_inside_the_window(spark):
    """One scope holds nearly all rows; blocks of 7 rows, ties in time, missing vectors and keys, other widths."""
    random.seed(1)
    base = [[random.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(220):
        vec = [x + random.gauss(0, 0.05) for x in random.choice(base)] if i % 11 else random.choice((None, [], [0.0] * 6, [1.0, 2.0]))
        rows.append((i, "hot" if i % 9 else random.choice(("a", None)), random.randrange(0, 4000) // 7, random.choice((None, f"k{i % 40}")), vec))
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "id long, scope string, at long, key string, vec array<double>, block string, slot int")
    for window in (3, 60, 10_000):
        found = {r.id: (r.reused_at, r.reused_id, r.similarity) if r.reused_id is not None else None for r in reuse.similar_reuse(frame, window, 0.9, block_rows=7).collect()}
        want = brute([(i, s or "", a, k, v) for i, s, a, k, v in rows], window, 0.9)
        assert found.keys() == want.keys()
        for i, w in want.items():
            assert (found[i] is None) == (w is None) and (w is None or (found[i][:2] == w[:2] and abs(found[i][2] - w[2]) < 1e-8))


def test_no_pair_of_blocks_outside_the_window(spark):
    frame = spark.createDataFrame([(i, "s", i * 10, None, [1.0, float(i)]) for i in range(300)], "id long, scope string, at long, key string, vec array<double>")
    rows = frame.withColumn("slot", (frame["at"] / 100).cast("long"))
    pairs = reuse._met(reuse._time_blocks(rows, 4), 100).collect()
    assert pairs and all(p.b_low <= p.a_high and p.b_high >= p.a_low - 100 for p in pairs)
    assert len(pairs) < 300 / 4 * 10
    assert reuse.similar_reuse(frame.where("id < 0")).collect() == []
