"""A Spark session for tests, benchmarks and notebooks; clusters bring their own."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cores: str | int = "*", name: str = "wayline", shuffle_partitions: int = 8,
                  memory: str = "12g", checkpoint_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins whose every partition is small are hashed instead of sorted, decided from measured sizes
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Python workers import this package, wherever the driver was started
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, [str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH")])))
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()
