"""Analytics of training logs: step records of many runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(df: DataFrame, run: str, order: str, value: str, beta: float = 0.9) -> DataFrame:
    """Add ema: the debiased moving average from 0 over all rows so far, for any ``beta`` between 0 and 1.

    A run's rows are summed in blocks with the weights beta^-k, in which the largest is e^200. What a block gets from
    before is its predecessor's sum; older blocks weigh less than e^-200, which no double keeps.
    """
    long = max(1, int(-200 / math.log(beta)))
    n = F.row_number().over(Window.partitionBy(run).orderBy(order))
    terms = df.withColumn("__n", n).withColumn("__b", F.floor((F.col("__n") - 1) / long)).withColumn("__k", (F.col("__n") - 1) % long)
    weigh = lambda k: F.pow(F.lit(beta), k)
    ends = terms.groupBy(run, (F.col("__b") + 1).alias("__b")).agg(F.sum(F.col(value) * weigh(long - 1 - F.col("__k"))).alias("__end"))
    own = F.sum(F.col(value) * weigh(-F.col("__k"))).over(Window.partitionBy(run, "__b").orderBy("__n")) * weigh(F.col("__k"))
    met = terms.withColumn("__own", own).join(ends, [run, "__b"], "left")
    total = F.col("__own") + F.coalesce("__end", F.lit(0.0)) * weigh(F.col("__k") + 1)
    return met.withColumn("ema", (1 - beta) * total / (1 - weigh(F.col("__n")))).select(*df.columns, "ema")


def throughput(df: DataFrame, run: str, step: str, dt: str, tokens: int, steps: int, skip: int = 10) -> DataFrame:
    """Add tokens_per_sec, progress in percent, total_time after the first ``skip`` steps, and eta in seconds."""
    total = F.sum(F.when(F.col(step) > skip, F.col(dt)).otherwise(0.0)).over(Window.partitionBy(run).orderBy(step))
    out = df.withColumn("tokens_per_sec", F.try_divide(F.lit(float(tokens)), F.col(dt))).withColumn("progress", F.col(step) * 100.0 / steps).withColumn("total_time", total)
    done = F.col(step) - skip
    return out.withColumn("eta", F.when(done > 0, F.col("total_time") / done * (steps - F.col(step))))


def utilization(df: DataFrame, rate: Column, peaks: DataFrame, device: str) -> DataFrame:
    """Add mfu in percent: ``rate`` over the peak of the first pattern (ord, pattern, flops) that the device's name holds.

    Devices are matched once each, not each row.
    """
    names = df.select(device).distinct()
    hit = names.join(F.broadcast(peaks), F.lower(F.col(device)).contains(F.col("pattern")))
    best = hit.groupBy(device).agg(F.min_by("flops", "ord").alias("peak"))
    return df.join(best, device, "left").withColumn("mfu", 100 * rate / F.col("peak"))


def running_best(df: DataFrame, run: str, order: str, value: str) -> DataFrame:
    return df.withColumn("best", F.min(value).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
