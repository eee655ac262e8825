"""Session builder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "millrace", cores: int | str | None = None, **extra: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; local unless a master is set by the launcher."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        n = os.cpu_count() if cores == "*" else int(cores)
        builder = builder.master(f"local[{cores}]")
        conf.setdefault("spark.sql.shuffle.partitions", str(n))
        conf.setdefault("spark.driver.memory", "12g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
