"""Session defaults for local work; a cluster brings its own configuration."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "duskwire", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """Local session. On a cluster use the session the cluster hands out instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DUSKWIRE_DRIVER_MEMORY", "12g"))
    )
    return builder.getOrCreate()
