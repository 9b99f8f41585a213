"""Session helpers: a local session for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "panelwright", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # one task per file is too many when thousands of leaves are listed on one machine
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", "32")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Taken from the session's ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder of its own; a cluster session must name one.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY, "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelwright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()  # with its scheme, so that tasks and the driver mean the same place


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from reliable storage.

    Used where a frame feeds several jobs (model fits, multi-pass quantiles), so that
    neither a lost executor nor a second branch repeats the scan of the facts.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
