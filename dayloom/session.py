"""A session with the settings the library expects."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf) -> SparkSession:
    b = SparkSession.builder.master(master).appName("dayloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {"spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``; where that is unset, on this machine, if Spark runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file:///tmp/checkpoints/dayloom"
        os.makedirs(where[7:], exist_ok=True)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
