"""Streaming jobs run to completion over the shared event table, checked against the same SQL as their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import cut_folder
from ..streaming import jobs
from .events import GAP_SQL
from .registry import query


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over everything there is and reads back the last batch's result table."""
    spark = stream.sparkSession
    root = f"{cut_folder(spark)}/{uuid.uuid4().hex}"
    written = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")
        written.append(number)

    job = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/{written[0]}") if len(written) == 1 else spark.read.schema(stream.schema).parquet(
        *[f"{root}/out/{n}" for n in (written[-1:] if mode == "complete" else written)])


def event_stream(t) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query("stream_counters", """SELECT 'host' AS kind, 'u' || user_id % 20 AS name, event_type AS counter, count(*) AS total FROM events GROUP BY ALL""")
def _counters(t):
    rows = event_stream(t).select(F.lit("host").alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("event_type").alias("counter"), F.lit(1).alias("n"))
    return run_available(jobs.counter_stream(rows), "complete")


@query("stream_working_memory", f"""WITH {GAP_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, max(run) OVER (PARTITION BY user_id) AS last_run, count(*) OVER (PARTITION BY user_id) AS total FROM runs),
v AS (SELECT user_id, event_type AS cue, max(value * pow(0.5, total - n)) AS activation FROM n WHERE run = last_run GROUP BY ALL)
SELECT user_id::VARCHAR AS key, cue, round(activation, 6) AS activation FROM v""")
def _working(t):
    updates = event_stream(t).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("update_id"), F.col("ts").cast("timestamp").alias("at"),
                                     F.col("event_type").alias("cue"), F.col("value").alias("activation"))
    held = run_available(jobs.working_memory_stream(updates), "update").where(~F.col("late"))
    last = held.groupBy("key").agg(F.max("updated_at").alias("updated_at"))
    return held.join(last, ["key", "updated_at"]).select("key", "cue", F.round("activation", 6).alias("activation"))
