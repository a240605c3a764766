"""Session settings used by the bench and the tests; a cluster brings its own session."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", app: str = "barloom") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("BARLOOM_SHUFFLE", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        # long scoring expressions: methods above 8000 bytes are never compiled by the JVM
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
