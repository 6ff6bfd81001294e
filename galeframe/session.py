"""Session settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_FOLDER = os.path.join(tempfile.gettempdir(), "galeframe-shared")


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC, the zone of all series and runs."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(
    app: str = "galeframe", cores: str = "*", partitions: int = 8, shared: str = LOCAL_FOLDER
) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", shared)
        .config("spark.driver.memory", os.environ.get("GALEFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, the one ``spark.checkpoint.dir`` names.

    Only a local session may do without the setting: driver and executors are one process
    there, and take one fixed folder, so that a later session finds what an earlier one left.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return LOCAL_FOLDER
