"""Benchmark items, tasks, baselines; score and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, item.*) of JSON lines; blank lines give no row but count in the numbering (from 1).

    A line's number is its place in its file: offsets of the splits before it (one count a partition) plus its place in
    the split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    part = F.shiftright("at", 33)
    per = raw.groupBy("file", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    base = per.withColumn("base", F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n"))
    raw = raw.withColumn("part", part).join(F.broadcast(base.select("file", "part", "base", "first")), ["file", "part"])  # a row a split
    rows = raw.where(F.trim("value") != "").select("file", (F.col("base") + F.col("at") - F.col("first") + 1).alias("line"), F.from_json("value", schemas.ITEM).alias("item"))
    return rows.select("file", "line", "item.*")


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """(label, random_baseline in percent) from a CSV with those two columns."""
    return spark.read.option("header", True).schema(schemas.BASELINE).csv(path)


def read_tasks(spark: SparkSession, tasks: list[dict]) -> DataFrame:
    """The task table from parsed configuration (tens of rows)."""
    names = schemas.TASK.fieldNames()
    return spark.createDataFrame([tuple(t.get(n) for n in names) for t in tasks], schemas.TASK)


def select_tasks(tasks: DataFrame, labels: DataFrame, overrides: DataFrame | None = None, shots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen tasks, labels that name no task). A task's own override of num_fewshot wins over the global one."""
    chosen = tasks.join(labels, "label", "left_semi")
    missing = labels.join(tasks, "label", "left_anti")
    every = F.lit(shots).cast("int")
    if overrides is not None:
        chosen = chosen.join(overrides.select("label", F.col("num_fewshot").alias("__own")), "label", "left")
        return chosen.withColumn("num_fewshot", F.coalesce("__own", every, "num_fewshot")).drop("__own"), missing
    return chosen.withColumn("num_fewshot", F.coalesce(every, "num_fewshot")), missing


def subsample(df: DataFrame, task: str, item: str, most: int, seed: int = 1337) -> DataFrame:
    """At most ``most`` items a task in an order drawn by hash; the draw is deterministic and independent of partitions."""
    order = Window.partitionBy(task).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(item).cast("string")).cast("binary")), F.col(item))
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def score_lines(scores: DataFrame, expected: int | None = None) -> DataFrame:
    """(ord, task, accuracy, centered): one line a task in name order and one for their mean.

    That one is ``CORE``, or ``CORE_PARTIAL`` where there are fewer tasks with a score than ``expected``.
    """
    detail = scores.select(F.lit(0).alias("ord"), "task", "accuracy", "centered")
    label = F.when(F.count("centered") < (expected or 0), "CORE_PARTIAL").otherwise("CORE")
    total = scores.agg(F.avg("centered").alias("centered"), label.alias("task")).select(F.lit(1).alias("ord"), "task", F.lit(None).cast("double").alias("accuracy"), "centered")
    return detail.unionByName(total)


def write_scores(scores: DataFrame, root: str, run: str, variant: str = "", expected: int | None = None) -> str:
    """Write the score lines as one CSV file under a folder named after the run, so runs never overwrite each other."""
    path = f"{root}/{run}{'_' + variant if variant else ''}"
    score_lines(scores, expected).orderBy("ord", "task").drop("ord").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("task string, accuracy double, centered double").csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRIC).json(path)


def latest_per_run(df: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Each run's row of the highest step."""
    return df.groupBy(run).agg(F.max_by(F.struct("*"), F.col(step)).alias("__row")).select("__row.*")
