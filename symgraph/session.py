"""A session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "symgraph", cpus: int | str | None = None) -> SparkSession:
    """Adaptive execution on, UTC; master and partitions only where none are given."""
    n = str(cpus or os.environ.get("BENCH_CPUS") or "*")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{n}]").config("spark.driver.memory", "6g").config(
            "spark.sql.shuffle.partitions", "16" if n == "*" else str(2 * int(n))
        )
    return builder.getOrCreate()
