"""Reuse of earlier searches: an as-of join by key or by vector, the latest match within a window of time.

Searches of a scope are laid out in time: range partitions sorted by (scope, slot, time) are cut into blocks of bounded size, a slot being one window long, so
a search's partners lie in its own slot and the one before. Blocks meet by an equi-join on (scope, slot, part); a slot's blocks are dealt to as
many parts as their number asks for, so a busy scope is many tasks, and pairs of blocks without a moment inside the window are never formed. A task
compares one pair of blocks with one matrix product and hands on the latest match of each search only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .nearest import cosine_scores

BLOCK_ROWS, PART_BLOCKS = 512, 8


def _time_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(scope, slot, block, low, high, ids, ats, keys, sizes, vec): at most `size` rows of one scope and slot each, in time order."""
    order = ["scope", "slot", "at", "id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, place = TaskContext.get().partitionId() << 32, [], None

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            whole = pa.Table.from_batches(held).combine_chunks()
            ats, vectors = whole["at"].to_numpy(), whole["vec"].combine_chunks()
            vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
            sizes = [n or 0 for n in vectors.value_lengths().to_pylist()]
            out = {"scope": [place[0]], "slot": [place[1]], "block": [number], "low": [int(ats[0])], "high": [int(ats[-1])], "ids": [whole["id"].to_pylist()],
                   "ats": [ats.tolist()], "keys": [whole["key"].to_pylist()], "sizes": [sizes], "vec": [vectors.flatten().to_numpy(zero_copy_only=False)]}
            held.clear()
            return pa.RecordBatch.from_pydict(out, schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("scope", pa.string()), ("slot", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                                          ("ids", pa.list_(batch.schema.field("id").type)), ("ats", pa.list_(pa.int64())), ("keys", pa.list_(pa.string())),
                                          ("sizes", pa.list_(pa.int32())), ("vec", pa.list_(pa.float64()))])
            places = list(zip(batch.column("scope").to_pylist(), batch.column("slot").to_pylist()))
            low = 0
            for row, here in enumerate(places):
                if here != place or sum(b.num_rows for b in held) + row - low >= size:
                    if row > low:
                        held.append(batch.slice(low, row - low))
                    if held:
                        yield block()
                    low, place = row, here
            if low < len(places):
                held.append(batch.slice(low))
        if held:
            yield block()

    kind = rows.schema["id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"scope string, slot long, block long, low long, high long, ids array<{kind}>, ats array<long>, keys array<string>, "
                                   "sizes array<int>, vec array<double>")


def _met(blocks: DataFrame, window: int) -> DataFrame:
    """Pairs of blocks (asked a_, earlier b_) that hold moments inside the window."""
    counts = blocks.groupBy("scope", "slot").agg(F.ceil(F.count(F.lit(1)) / PART_BLOCKS).cast("int").alias("parts"))
    earlier = blocks.join(counts, ["scope", "slot"]).withColumn("part", F.pmod(F.col("block"), F.col("parts")))
    earlier = earlier.select("scope", F.col("slot").alias("at_slot"), "part", *[F.col(c).alias(f"b_{c}") for c in blocks.columns if c not in ("scope", "slot")])
    wanted = counts.select("scope", F.col("slot").alias("at_slot"), "parts", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    asked = blocks.join(wanted, ["scope", "slot"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("scope", "at_slot", "part", *[F.col(c).alias(f"a_{c}") for c in blocks.columns if c not in ("scope", "slot")])
    inside = (F.col("b_low") <= F.col("a_high")) & (F.col("b_high") >= F.col("a_low") - window)
    return asked.join(earlier, ["scope", "at_slot", "part"]).where(inside)


def similar_reuse(asked: DataFrame, window_seconds: int = 30 * 86400, threshold: float = 0.94, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per search its latest earlier one in the same scope, at most the window before, with the same key or vectors at least `threshold` close.

    asked: id, scope, at (seconds), key (null: none), vec. Searches of one moment are in the order of their ids. Adds reused_id, reused_at and
    similarity, 1 for equal keys; null where nothing is reused. Vectors of different lengths and missing ones are not alike.
    """
    rows = asked.select("id", F.col("scope").cast("string").alias("scope"), F.col("at").cast("long").alias("at"), F.col("key").cast("string").alias("key"),
                        F.coalesce(F.col("vec").cast("array<double>"), F.array().cast("array<double>")).alias("vec"))
    rows = rows.where("id is not null and at is not null").withColumn("scope", F.coalesce("scope", F.lit("")))
    blocks = cut_lineage(_time_blocks(rows.withColumn("slot", F.floor(F.col("at") / window_seconds).cast("long")), block_rows))
    kind = rows.schema["id"].dataType.simpleString()
    names = [f"{s}_{c}" for s in "ab" for c in ("ids", "ats", "keys", "sizes", "vec")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].values for n in names}
                at = {s: one[f"{s}_ats"].to_numpy() for s in "ab"}
                ids = {s: np.array(one[f"{s}_ids"].to_pylist(), object) for s in "ab"}
                score = cosine_scores(*[{"sizes": one[f"{s}_sizes"].to_numpy(), "vec": one[f"{s}_vec"].to_numpy()} for s in "ab"]).round(9)
                codes = {k: i for i, k in enumerate({k for k in one["a_keys"].to_pylist() if k is not None})}
                left = np.array([codes.get(k, -1) for k in one["a_keys"].to_pylist()])
                right = np.array([codes.get(k, -2) for k in one["b_keys"].to_pylist()])
                score = np.where(left[:, None] == right[None, :], 1.0, score)
                apart = at["a"][:, None] - at["b"][None, :]
                before = (apart > 0) | ((apart == 0) & (ids["b"][None, :] < ids["a"][:, None]))
                match = (score >= threshold) & before & (apart <= window_seconds)
                # The earlier block is in time order, so the last match of a row is its latest.
                found = np.flatnonzero(match.any(axis=1))
                latest = match.shape[1] - 1 - match[found][:, ::-1].argmax(axis=1)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids["a"][found].tolist(), one["a_ids"].type), "reused_id": pa.array(ids["b"][latest].tolist(), one["b_ids"].type),
                                                  "reused_at": pa.array(at["b"][latest]), "similarity": pa.array(score[found, latest])})

    matches = _met(blocks, window_seconds).select(*names).mapInArrow(run, f"id {kind}, reused_id {kind}, reused_at long, similarity double")
    last = matches.groupBy("id").agg(F.max(F.struct("reused_at", "reused_id", "similarity")).alias("m")).select("id", "m.reused_id", "m.reused_at", "m.similarity")
    return asked.join(last, "id", "left")


def reuse_counts(reused: DataFrame) -> DataFrame:
    """(id, reused): how often each search was reused."""
    return reused.where("reused_id is not null").groupBy(F.col("reused_id").alias("id")).agg(F.count(F.lit(1)).alias("reused"))
