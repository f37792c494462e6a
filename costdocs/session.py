"""Session settings for tests, the benchmark and local work."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from costdocs.sources.scratch import CHECKPOINT_DIR


def local_session(cores: str = "8", app: str = "costdocs", memory: str = "16g") -> SparkSession:
    """A local session; a cluster brings its own session and settings instead.

    Where the defaults name no checkpoint folder, it gets one of its own.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if not (spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="costdocs-"))
    return spark
