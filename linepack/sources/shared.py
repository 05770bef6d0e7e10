"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_FALLBACK: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under ``spark.checkpoint.dir`` that nothing else uses.

    Where the setting is missing a local session gets a temporary folder; on a cluster that would lose files, so it is
    an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        root = _FALLBACK[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
