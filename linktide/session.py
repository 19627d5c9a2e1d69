"""Session defaults and the two ways a long job cuts its lineage."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two sweeps at least.
SWEEP_SECONDS = 2.0
_swept = 0.0


def local_session(cores: str = "*", app: str = "linktide", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own;
    on a cluster a machine-local folder would lose data with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linktide-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints that nothing reads any more.

    Spark drops them when the driver collects its garbage, which a job that keeps little on the driver
    hardly ever does; an iteration would keep the files of all its steps.
    """
    global _swept
    if time.monotonic() - _swept > SWEEP_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and start a fresh plan from it."""
    ensure_checkpoint_dir(df.sparkSession)
    sweep(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
