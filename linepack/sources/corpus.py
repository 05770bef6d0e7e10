"""Corpus shards: split rules, sharding, replay, cursors, budgets, idempotent rewrites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip_leading_newlines
from ..operators.ranks import rank_rows
from . import published
from .shared import shared_path


@dataclass(frozen=True)
class CorpusSpec:
    """Shards at ``root``: by file name either all but the last are train and the last is val, or prefixes say so."""

    root: str
    train_prefix: str | None = None
    val_prefix: str | None = None


def shard_names(spark: SparkSession, root: str) -> list[str]:
    """Sorted Parquet file names, listed through Hadoop so that any store works."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))


def read_corpus(spark: SparkSession, spec: CorpusSpec, split: str) -> DataFrame:
    """(text, shard, ordinal) of one split. A corpus of one file is its own val and has no train rows."""
    names = shard_names(spark, spec.root)
    if spec.train_prefix is not None:
        mine = [n for n in names if n.startswith(spec.train_prefix if split == "train" else spec.val_prefix)]
    else:
        mine = names[:-1] if split == "train" else names[-1:]
    if not mine:
        return spark.createDataFrame([], "text string, shard string, ordinal bigint")
    df = spark.read.schema(schemas.CORPUS).parquet(*[f"{spec.root}/{n}" for n in mine])
    return df.select("text", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("ordinal"))


def split_by_group(df: DataFrame, group: str, split: str) -> DataFrame:
    """The split rule on a column that stands for the shard: the last value is val."""
    last = df.agg(F.max(group).alias("last"))
    joined = df.crossJoin(F.broadcast(last))  # one row
    return joined.where((F.col(group) == F.col("last")) == F.lit(split == "val")).drop("last")


def scan_text(df: DataFrame, batch: str | None = None) -> DataFrame:
    """The text column alone; the reader prunes the rest."""
    return df.select(*([batch] if batch else []), "text")


def assign_shard(df: DataFrame, ordinal: str, workers: int) -> DataFrame:
    """Worker of each row by a stride over a stable ordinal; no row has two workers however many there are."""
    return df.withColumn("worker", F.pmod(F.col(ordinal), F.lit(workers)).cast("int"))


def replay(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once for each epoch, numbered from 1."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))


def after_cursor(df: DataFrame, shard: str, ordinal: str, cursor: tuple[str, int]) -> DataFrame:
    """Rows strictly after a (shard, ordinal) cursor."""
    at, done = cursor
    return df.where((F.col(shard) >= at) & ((F.col(shard) > at) | (F.col(ordinal) > F.lit(done).cast("bigint"))))


def prepare_docs(df: DataFrame, col: str = "text") -> DataFrame:
    """Blank documents dropped, leading newlines stripped; null counts as blank."""
    clean = df.where(F.col(col).rlike(r"(?U)\S")).withColumn(col, strip_leading_newlines(F.col(col)))
    return clean.where(F.length(col) > 0)


def cap_chars(df: DataFrame, most: int = 10_000, col: str = "text") -> DataFrame:
    return df.withColumn(col, F.substring(col, 1, most))


def take_budget(df: DataFrame, size: Column, budget: int, shard: str, order: str, inclusive: bool = True) -> DataFrame:
    """Rows in (shard, order) while the running size is within the budget.

    ``inclusive`` keeps the row that crosses the budget (exclusive prefix <= budget), else the prefix must be below it. A
    null size counts as 0. Two small passes find where it is crossed: sums of the shards give the shard, sums of ranges of
    its rows the range. Shards before it are kept unread by a filter on ``shard``, later ones are never read again, and only
    the one range is ordered row by row. A budget beyond all rows keeps them all.
    """
    over = (lambda c: c > budget) if inclusive else (lambda c: c >= budget)
    sized = df.withColumn("__size", F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")))
    crossing = _crossing(sized.groupBy(shard).agg(F.sum("__size").alias("__sum")), shard, over)
    if crossing is None:
        return df
    at, base = crossing
    before = sized.where(F.col(shard) < at)
    own = sized.where(F.col(shard) == at)
    placed = _checkpointed(own.orderBy(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    inside = _crossing(placed.groupBy(part.alias("__part")).agg(F.sum("__size").alias("__sum")), "__part", lambda c: over(c + base))
    if inside is None:
        return before.unionByName(placed.drop("__at")).drop("__size")
    range_, more = inside
    cum = F.sum("__size").over(Window.partitionBy(part).orderBy("__at")) - F.col("__size") + base + more
    last = placed.where(part == range_).withColumn("__before", cum).where(~over(F.col("__before"))).drop("__before")
    return before.unionByName(placed.where(part < range_).unionByName(last).drop("__at")).drop("__size")


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "budget"))
    return df.checkpoint()


def _crossing(sums: DataFrame, key: str, over) -> tuple[object, int] | None:
    """The first ``key`` in order with whose rows the running sum is ``over`` the budget, and the sum before it; one row."""
    total = F.sum("__sum").over(Window.orderBy(key))  # a row a shard or range
    first = sums.withColumn("__total", total).where(over(F.col("__total"))).agg(F.min(F.struct(key, (F.col("__total") - F.col("__sum")).alias("b"))).alias("m")).first()["m"]
    return None if first is None else (first[key], first["b"])


def whole_steps(tokens: int, batch: int, length: int, workers: int) -> int:
    """Steps of batch * length * workers tokens in a budget, one at least."""
    return max(1, tokens // (batch * length * workers))


def round_budget(rows: DataFrame, order: str, tokens: int, batch: int, length: int, workers: int = 1) -> DataFrame:
    """The packed rows of the whole steps within a token budget: the first so many by ``order``, which is unique.

    Sums over ranges of the order tell how far the budget reaches; no task holds more than one range.
    """
    most = whole_steps(tokens, batch, length, workers) * batch * workers
    return rank_rows(rows, order).where(F.col("rank") < most).drop("rank")


def modified_stats(old: Column, new: Column) -> list[Column]:
    """Aggregates: documents, those changed, and their ratio."""
    changed = F.count_if(~old.eqNullSafe(new))
    return [F.count("*").alias("docs"), changed.alias("modified"), (changed / F.greatest(F.count("*"), F.lit(1))).alias("ratio")]


def rewrite_shards(spark: SparkSession, df: DataFrame, shard: str, out: str, fn: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Publish ``fn`` of every shard that ``out`` lacks; returns (shard, docs, modified, ratio) of those.

    ``fn`` works row by row and carries other columns along. Shards that the manifest of ``out`` names are skipped by a join,
    so a second call writes nothing; a call that is killed publishes nothing (``published``). Rows are counted from what was
    written: each says whether its text changed (column ``modified``). Large shards are dealt out over several tasks and
    small ones share them. ``published.read_published`` reads the result.
    """
    done = published.committed(spark, out).select(F.col("part").alias("__part")).distinct()
    todo = df.join(done, F.col(shard).cast("string").eqNullSafe(F.col("__part")), "left_anti").withColumn("__old", F.sha2("text", 256))
    fresh = fn(todo).withColumn("modified", ~F.sha2("text", 256).eqNullSafe(F.col("__old"))).drop("__old")
    folder = published.new_folder()
    fresh.hint("rebalance", shard).write.parquet(f"{out}/{folder}")
    written = spark.read.schema(fresh.schema).parquet(f"{out}/{folder}")
    counts = written.groupBy(F.col(shard).cast("string").alias("part")).agg(F.count("*").alias("docs"), F.count_if("modified").alias("modified"))
    published.commit(counts.withColumn("folder", F.lit(folder)), out)
    mine = published.committed(spark, out).where(F.col("folder") == folder)
    return mine.select(F.col("part").cast(df.schema[shard].dataType).alias(shard), "docs", "modified", (F.col("modified") / F.greatest("docs", F.lit(1))).alias("ratio"))
