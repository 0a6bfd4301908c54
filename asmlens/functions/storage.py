"""Folders for tables that a job writes for its own use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")  # one machine
    return f"{top.rstrip('/')}/asmlens-{uuid.uuid4().hex}"
