"""Session helpers: the local test session, lineage cuts and size-checked decisions."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lorekeep") -> SparkSession:
    """A single-machine session for tests and the bench. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small inputs with much work per row would otherwise end up in one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128kb")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOREKEEP_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage cuts go to: the one the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; a cluster job without it fails here, because
    a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="lorekeep-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes an iteration's result as a table in the checkpoint folder and reads it back.

    A lost executor then replays one round, not all; the next round gets a columnar input of known size. What was shuffled to make the table
    goes once it is written: nothing reads it again, and a job of many rounds would hold all of it on disk. The tables of
    an application lie in one folder of their own (see `cut_folder`).
    """
    path = f"{cut_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes a table that `cut_lineage` wrote. Only for tables that nothing reads any more: no result that is still to be computed may rest on it."""
    spark = df.sparkSession
    own = cut_folder(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own not in folder:
            raise ValueError(f"{folder} is not a table of this application")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the writes inside are removed at their end; the session's setting stands again afterwards. Versions that do not know the setting keep the files."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; it may be removed once the application has ended."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lorekeep-{spark.sparkContext.applicationId}"


def is_empty(df: DataFrame) -> bool:
    """Stop probe of the iterative operators: reads at most one row."""
    return len(df.take(1)) == 0
