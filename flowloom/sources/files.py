"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder only in local mode where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        own = os.path.join(tempfile.gettempdir(), "flowloom-shared")
        os.makedirs(own, exist_ok=True)
        root = f"file://{own}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
