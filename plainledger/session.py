"""Session helpers: the shared folder for cut lineage and the test session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Tasks to which tables in too few file splits are dealt; unset, none is.
SPREAD_KEY = "plainledger.spread.tasks"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A local session without the setting gets a temporary folder; on a cluster a
    missing setting is an error, because a machine-local folder would be lost
    with its host.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    if context.applicationId not in _local_dirs:
        folder = _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="plainledger-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_dirs[context.applicationId]


def run_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in a table of the shared folder, which outlives an executor.

    A written table also gives the planner its real size, so a later join with a
    small one can be broadcast under the usual size check.
    """
    spark = df.sparkSession
    path = run_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the tables that `cut` wrote for these frames; nothing may read them any more."""
    for frame in frames:
        hadoop = frame.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cpus: int | str = 8, name: str = "plainledger") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(SPREAD_KEY, "8" if cpus == "*" else str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
