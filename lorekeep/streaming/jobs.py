"""Structured Streaming twins of the memory jobs: log tailing, counters, gaps, working memory, traces, late rows, upserts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import upsert
from ..operators.traces import EXPLORED, observations


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New event files as a stream; the query's checkpoint takes the place of a cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tail_log(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Delivers each batch of events in sequence order per query, closing markers last."""
    closing = F.col("event_type").isin("QUERY_COMPLETED", "QUERY_FAILED")

    def ordered(batch: DataFrame, number: int) -> None:
        deliver(batch.withColumn("terminal", closing).orderBy("query_id", "terminal", "sequence"), number)

    writer = events.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def counter_stream(events: DataFrame) -> DataFrame:
    """Running totals per (kind, name, counter); sums combine before the shuffle, so a hot host stays cheap. Update mode."""
    return events.where(F.length("name") > 0).groupBy("kind", "name", "counter").agg(F.sum("n").alias("total"))


def session_stream(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "3 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions closed by a gap, with late rows bounded by the watermark."""
    return (events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"))


def working_memory_stream(updates: DataFrame, hours: float = 3, decay: float = 0.5, size: int = 40, delay: str = "1 hour") -> DataFrame:
    """(key, cue, activation, updated_at, late) of every encounter a batch touched. Update mode.

    A row that is older than the state is handed on unchanged with `late` set, for the sink to keep aside (`with_late_table`);
    the state itself never goes back. updates: key string, update_id long, at timestamp, cue string, activation double. State is at most `size` cues; an
    encounter is dropped by an event-time timer after `hours` without use.
    """
    output = "key string, cue string, activation double, updated_at timestamp, late boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = (None, {}) if not state.exists else (state.get[0], json.loads(state.get[1]))
        rows = pd.concat(list(batches)).sort_values(["at", "update_id"])
        for (at, _), update in rows.groupby(["at", "update_id"], sort=True):
            now = at.timestamp()
            if last is not None and now < last:
                yield pd.DataFrame({"key": key[0], "cue": update["cue"].to_numpy(), "activation": update["activation"].to_numpy(), "updated_at": at, "late": True})
                continue
            held = {} if last is not None and now - last > hours * 3600 else {c: v * decay for c, v in held.items()}
            for cue, value in zip(update["cue"], update["activation"]):
                held[cue] = max(held.get(cue, 0.0), float(value))
            held = dict(sorted(held.items(), key=lambda item: (-item[1], item[0]))[:size])
            last = now
        state.update((last, json.dumps(held)))
        state.setTimeoutTimestamp(max(int((last + hours * 3600) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "cue": pd.Series(list(held), dtype=object), "activation": list(held.values()), "updated_at": pd.Timestamp(last, unit="s").round("us"), "late": False})

    return (updates.withWatermark("at", delay).groupBy("key")
            .applyInPandasWithState(step, output, "last double, held string", "update", GroupStateTimeout.EventTimeTimeout))


def with_late_table(deliver: Callable[[DataFrame, int], None], late_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that delivers rows on time and keeps late ones in a folder per batch, so a repeated batch
    replaces its own late rows only."""
    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        deliver(batch.where(~F.col("late")).drop("late"), number)
        batch.unpersist()

    return sink


def trace_state_stream(events: DataFrame) -> DataFrame:
    """(query_id, node, state) of every node a batch of trace events touched. Update mode.

    State is kept per (query, node), a single word each, so one busy query is spread over its nodes.
    """
    def advance(current, how, state):
        explored = current in EXPLORED
        if how == "upsert":
            return current if current == "EVIDENCE" or (explored and state not in EXPLORED) else state
        if current is None or how == "reject":
            return current and state
        return current if current == "EVIDENCE" or (state == "PRUNED" and explored) else state

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else None
        for row in pd.concat(list(batches)).sort_values(["sequence", "part"]).itertuples():
            current = advance(current, row.how, row.state)
        if current is not None:
            state.update((current,))
            yield pd.DataFrame({"query_id": [key[0]], "node": [key[1]], "state": [current]})

    return observations(events).groupBy("query_id", "node").applyInPandasWithState(
        step, "query_id string, node string, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def split_late(batch: DataFrame, marks: DataFrame, at: str = "ts", delay_hours: int = 1) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a batch against the newest time seen in earlier batches (one-column table `mark`)."""
    mark = marks.agg(F.max("mark")).scalar()
    late = F.coalesce(F.col(at) < mark - F.make_dt_interval(F.lit(0), F.lit(delay_hours)), F.lit(False))
    return batch.where(~late), batch.where(late)


def snapshot_upserts(spark: SparkSession, root: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a keyed table as numbered snapshots: a batch merges into the snapshot before it.

    Writing the same batch again replaces its own snapshot only, so a restarted batch changes nothing.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()

    def merge(batch: DataFrame, number: int) -> None:
        earlier = [n for n in range(number) if _complete(hadoop, conf, f"{root}/{n}")][-1:]
        merged = upsert(batch, batch, keys, F.col(version)) if not earlier else upsert(
            spark.read.parquet(f"{root}/{earlier[0]}"), batch, keys, F.col(version))
        merged.write.mode("overwrite").parquet(f"{root}/{number}")

    return merge


def _complete(hadoop, conf, folder: str) -> bool:
    path = hadoop.Path(folder + "/_SUCCESS")
    return path.getFileSystem(conf).exists(path)
