"""Streaming jobs against their batch twins on the same events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lorekeep.operators import memory, traces
from lorekeep.streaming import jobs


def run_stream(stream, tmp_path, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_counters_match_batch(spark, tmp_path):
    rows = [("host", f"h{i % 3}", ["found", "used"][i % 2], 1) for i in range(50)]
    df = spark.createDataFrame(rows, "kind string, name string, counter string, n int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.counter_stream(jobs.event_stream(spark, str(tmp_path / "in"), df.schema, 1))
    last = run_stream(stream, tmp_path, "counts", "update").groupBy("name", "counter").agg(F.max("total").alias("total"))
    expected = df.groupBy("name", "counter").agg(F.sum("n").alias("total"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, expected.collect()))


def test_working_memory_matches_batch(spark, tmp_path):
    rng, at, rows = random.Random(1), dt.datetime(2024, 1, 1), []
    for i in range(40):
        at += dt.timedelta(minutes=rng.choice([5, 50, 190]))
        rows.append((f"k{i % 2}", i, at, f"c{rng.randint(0, 5)}", rng.random()))
    df = spark.createDataFrame(rows, "key string, update_id long, at timestamp, cue string, activation double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.working_memory_stream(jobs.event_stream(spark, str(tmp_path / "in"), df.schema), size=4)
    got = run_stream(stream, tmp_path, "held", "update")
    expected = memory.working_memory(df.withColumn("at", F.col("at").cast("timestamp_ntz")), ["key"], size=4)
    assert sorted((r["key"], r["cue"], round(r["activation"], 9)) for r in got.collect()) == sorted((r["key"], r["cue"], round(r["activation"], 9)) for r in expected.collect())


def trace_rows(spark):
    base = {f: None for f in [c.split()[0] for c in traces.EVENT_SCHEMA.split(", ")]}
    def event(n, kind, **more):
        return {**base, "query_id": "q", "sequence": n, "event_type": kind, "need_id": "N1", **more}
    rows = [event(1, "QUERY_DECOMPOSED", needs=["N1"]), event(2, "CANDIDATES_GENERATED", candidates=["a", "b", "c"]), event(3, "BRANCH_SPAWNED", node_id="a", branch_id="x", path=["a"]),
            event(4, "NODE_PRUNED", node_id="b"), event(5, "NODE_SELECTED", node_id="a", shown="a"), event(6, "EVIDENCE_FOUND", node_id="a", evidence_id="e", evidence_node="a"),
            event(7, "CANDIDATES_GENERATED", candidates=["a", "b"]), event(8, "NODE_PRUNED", node_id="a"), event(9, "BACKTRACK", node_id="c"), event(10, "NODE_PRUNED", node_id="unseen")]
    return spark.createDataFrame([tuple(r.values()) for r in rows], traces.EVENT_SCHEMA)


def test_trace_states_batch_and_stream(spark, tmp_path):
    events = trace_rows(spark)
    expected = {"need:N1": "ACTIVE", "a": "EVIDENCE", "b": "CANDIDATE", "c": "DEAD_END", "e": "EVIDENCE"}
    assert {r["node"]: r["state"] for r in traces.node_states(events).collect()} == expected
    links = {(r["src"], r["dst"]): r["caption"] for r in traces.edge_states(events).collect()}
    assert links[("need:N1", "a")] == "route" and links[("a", "e")] == "supports" and links[("need:N1", "b")] == "candidate"
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run_stream(jobs.trace_state_stream(jobs.event_stream(spark, str(tmp_path / "in"), events.schema)), tmp_path, "nodes", "update")
    assert {r["node"]: r["state"] for r in got.collect()} == expected


def test_tail_sessions_late_rows_and_upserts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, base + dt.timedelta(hours=2 * i), "QUERY_COMPLETED" if i == 5 else "X") for i in range(6)]
    df = spark.createDataFrame(rows, "sequence long, query_id int, ts timestamp, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = jobs.event_stream(spark, str(tmp_path / "in"), df.schema)
    jobs.tail_log(stream, lambda b, n: seen.extend(r["sequence"] for r in b.collect()), str(tmp_path / "tail")).awaitTermination(60)
    assert seen == [0, 2, 4, 1, 3, 5]
    sessions = run_stream(jobs.session_stream(stream, "query_id"), tmp_path, "sessions", "append")
    assert sessions.count() >= 2
    on_time, late = jobs.split_late(df, spark.createDataFrame([(base + dt.timedelta(hours=6),)], "mark timestamp"))
    assert sorted(r["sequence"] for r in late.collect()) == [0, 1, 2] and on_time.count() == 3
    merge = jobs.snapshot_upserts(spark, str(tmp_path / "table"), ["key"], "at")
    first = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "key string, v int, at int")
    merge(first, 0)
    for _ in range(2):  # a restarted batch changes nothing
        merge(spark.createDataFrame([("a", 2, 2)], "key string, v int, at int"), 1)
    assert sorted((r["key"], r["v"]) for r in spark.read.parquet(str(tmp_path / "table" / "1")).collect()) == [("a", 2), ("b", 1)]
