"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing a local session gets a temporary folder; a cluster without it is an error, as a
    machine-local folder would lose files there.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="spark-linepack-"))
    return _FALLBACK[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/linepack/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drawn(col: str, seed: int, share: Column) -> Column:
    """Whether a row belongs to a sample of ``share`` (0 to 1) of all values of ``col``, by 62 bits of a hash of it."""
    return F.expr(f"xxhash64({col}, {seed}) & {(1 << 62) - 1}L") < (share * float(1 << 62))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
