"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; below a temporary folder only where all runs in one local process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, key = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if key not in _local:
            _local[key] = tempfile.mkdtemp(prefix="lodestrata-")
        root = _local[key]
    return f"{root.rstrip('/')}/lodestrata/{name}-{uuid.uuid4().hex}"
