"""A local session for tests and benchmarks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: str | None = None, partitions: int | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    n = partitions or (int(cpus) if cpus.isdigit() else 8)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("timberline")
             .config("spark.sql.shuffle.partitions", n).config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.maxMetadataStringLength", "2000").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
