"""Resumable ingest: new shards once each, cleaned; the checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schemas
from ..sources import published
from ..functions.text import cap_newline_runs
from ..sources.corpus import prepare_docs


def stream_corpus(spark: SparkSession, path: str, files_at_once: int = 16, schema: StructType = schemas.CORPUS) -> DataFrame:
    """Shards at ``path`` as they appear: blank documents dropped, newline runs capped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    clean = prepare_docs(raw)
    return clean.withColumn("text", cap_newline_runs(clean["text"]))


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there now and stop; a later call with the same checkpoint reads only what is new."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batches(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Write ``work`` of all that is there now, batch by batch, each batch once.

    ``work`` may aggregate, loop or pack, as it gets a whole micro-batch. The batch's number is its transaction: a batch that
    fails anywhere is run again under the same number, writes over its own folder, and counts when the manifest of ``out``
    names it; one that the manifest names already is left alone. ``published.read_published`` reads the result.
    """
    def publish(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"batch-{number}"
        if not published.committed(spark, out).where(F.col("folder") == folder).isEmpty():
            return
        work(batch).write.mode("overwrite").parquet(f"{out}/{folder}")
        docs = spark.read.parquet(f"{out}/{folder}").agg(F.count("*").alias("docs"))
        published.commit(docs.select(F.lit(folder).alias("folder"), F.lit(str(number)).alias("part"), "docs", F.lit(0).alias("modified")), out)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
