"""Output that appears whole or not at all: written aside, and committed by a row in a manifest.

A writer puts its rows into a folder of its own under ``out``; nothing reads that folder until the manifest names it. The
manifest is a small Parquet table beside the folders, and each commit appends one file to it, which Spark's writer makes
visible in one step on any store. A run that is killed leaves a folder that no reader sees and a later run does not count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
SCHEMA = "folder string, part string, docs bigint, modified bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def committed(spark: SparkSession, out: str) -> DataFrame:
    """(folder, part, docs, modified): a row for each part that is published at ``out``; none where nothing is."""
    path = f"{out}/{MANIFEST}"
    return spark.read.schema(SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SCHEMA)


def commit(rows: DataFrame, out: str) -> None:
    """Append ``rows`` to the manifest: all of them at once, as one file."""
    rows.select("folder", "part", F.col("docs").cast("bigint").alias("docs"), F.col("modified").cast("bigint").alias("modified")).coalesce(1).write.mode("append").parquet(f"{out}/{MANIFEST}")


def new_folder() -> str:
    return f"run-{uuid.uuid4().hex}"


def read_published(spark: SparkSession, out: str) -> DataFrame | None:
    """The rows of all committed folders (one for each run or batch), None where nothing is committed."""
    folders = sorted(r["folder"] for r in committed(spark, out).select("folder").distinct().collect())
    return spark.read.parquet(*[f"{out}/{f}" for f in folders]) if folders else None
