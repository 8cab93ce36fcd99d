"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, label: str = "scratch") -> str:
    """A new path below ``spark.checkpoint.dir``, visible to every executor.

    Only a local-mode session may go without the setting; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
