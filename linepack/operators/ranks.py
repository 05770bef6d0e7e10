"""Places in a total order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def rank_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add rank (from 0) in a total ``order``: sorted by ranges, places in a range, and a sum of rows for each range.

    The sorted rows are checkpointed, so that the places and the sums are of the same ranges. No task holds more than one.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "ranks"))
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    per = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    base = per.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # a row a range
    met = placed.withColumn("__part", part).join(F.broadcast(base), "__part")
    return met.withColumn("rank", F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__base", "__at")
