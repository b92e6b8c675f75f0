"""Tables that are replaced key by key: an append log of batches with a manifest.

A batch is written below its own folder, rows and the keys it replaces, and counts once its line is in the manifest, which is written last: what a job that
died half-way left behind is never read. A key's rows all come from one batch, the one that was made last (`at`, then the order of the
batches), so an older delivery that arrives late never wins, and a reader sees one version of every key. A batch rewrites nothing; `compact`
writes the current rows as one batch, from which readers then start. One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "number long, folder string, base boolean"


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str):
        """`schema` describes the rows, keys included."""
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{self.path}/manifest/start")

    def batches(self) -> list[tuple[int, str]]:
        """(number, folder) of the batches that count, from the last compaction on. Their number is what compaction bounds."""
        lines = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*")
        base = lines.where("base").agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        return [(r.number, r.folder) for r in lines.where(F.col("number") >= base).orderBy("number", "folder").collect()]

    def _next(self) -> int:
        return 1 + (self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*").agg(F.coalesce(F.max("number"), F.lit(0))).first()[0])

    def _write(self, rows: DataFrame, keys: DataFrame) -> str:
        """Rows and keys, each with `_at`, below a new folder that does not count yet."""
        folder = f"{self.path}/batches/{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}/rows")
        keys.write.parquet(f"{folder}/keys")
        return folder

    def _count(self, folder: str, base: bool = False) -> int:
        number = self._next()
        line = self.spark.createDataFrame([(number, folder, base)], MANIFEST)
        line.coalesce(1).write.parquet(f"{self.path}/manifest/{number:012d}-{uuid.uuid4().hex}")
        return number

    def append(self, rows: DataFrame, at, keys: DataFrame | None = None) -> int:
        """Replaces the keys of `rows`, or those in `keys`, which may have no rows any more, as of the moment `at` (a number). Returns the batch's number."""
        moment = F.lit(at).cast("double").alias("_at")
        replaced = (rows if keys is None else keys.select(self.key).unionByName(rows.select(self.key))).select(*self.key, moment).distinct()
        names = [f.split()[0].strip("`") for f in _fields(self.schema)]
        return self._count(self._write(rows.select(*names, moment), replaced))

    def _read(self, part: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, _at double, _batch long")
        for number, folder in self.batches():
            out = out.unionByName(self.spark.read.schema(f"{schema}, _at double").parquet(f"{folder}/{part}").withColumn("_batch", F.lit(number)))
        return out

    def _winners(self) -> DataFrame:
        keys = ", ".join(f for f in _fields(self.schema) if f.split()[0].strip("`") in self.key)
        latest = self._read("keys", keys).groupBy(*self.key).agg(F.max(F.struct("_at", "_batch")).alias("w"))
        return latest.select(*self.key, F.col("w._at").alias("_at"), F.col("w._batch").alias("_batch"))

    def current(self, versions: bool = False) -> DataFrame:
        """The rows of every key's last version; with `versions` also `_at` and `_batch`."""
        rows, last = self._read("rows", self.schema).alias("r"), self._winners().alias("w")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*self.key, "_at", "_batch"]]
        return rows.join(last, same, "left_semi").drop(*([] if versions else ["_at", "_batch"]))

    def compact(self) -> int:
        """One batch with all current rows, and the keys that have none, each with the moment of its version."""
        return self._count(self._write(self.current(versions=True).drop("_batch"), self._winners().drop("_batch")), base=True)


def _fields(schema: str) -> list[str]:
    """The fields of a schema string, split at its outer commas."""
    out, depth = [""], 0
    for letter in schema:
        depth += (letter in "<(") - (letter in ">)")
        if letter == "," and depth == 0:
            out.append("")
        else:
            out[-1] += letter
    return [f.strip() for f in out]


# --- Runs that can be resumed ---
def pending(work: DataFrame, log: KeyedLog, limit: int = 3) -> DataFrame:
    """The work that is neither done nor has failed `limit` times, with `failures` so far. The log's rows hold status and failures."""
    state = log.current().select(*log.key, "status", F.col("failures").alias("failures"))
    left, right = work.alias("w"), state.alias("s")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in log.key]
    joined = left.join(right, same, "left")
    open_ = F.col("s.status").isNull() | ((F.col("s.status") != "done") & (F.col("s.failures") < limit))
    return joined.where(open_).select("w.*", F.coalesce("s.failures", F.lit(0)).alias("failures"))


def resume(work: DataFrame, log: KeyedLog, run, at, limit: int = 3) -> int:
    """Runs what is pending and logs it as one batch. `run` takes the pending rows and returns them with `status` (done or failed) and its results."""
    found = run(pending(work, log, limit))
    return log.append(found.withColumn("failures", F.col("failures") + F.when(F.col("status") == "done", 0).otherwise(1)), at)
