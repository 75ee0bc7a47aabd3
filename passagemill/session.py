"""Session helpers: where lineage is cut, how wide a CPU-bound stage runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none, and the master is a local one (tests), a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if shared is None:
        shared = tempfile.mkdtemp(prefix="passagemill-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a DataFrame that reads it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, for what is read more than once, by few of its columns.

    The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the driver is ending; its JVM may be gone
        pass


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-bound stage at least as many tasks as the cluster has cores.

    A scan of many splits is returned as it is, without a shuffle; the rows of one of a few large splits are dealt out
    in turn, so that no hot key or repeated row can make one task larger (Spark sorts them first, so that a task that
    runs again deals them out alike).
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
