"""Token counts with a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens): the digest of a tokenizer version, that of a normalised
text, the stored count. Texts are joined to it by both digests; only distinct texts without a count are encoded, and
their counts are appended. A task that runs again writes nothing twice, as Spark commits an append as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"


@lru_cache(2)
def _encoder(path: str):
    """A function from texts to counts; one copy for each Python worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(p.encode(x, out_type=int, num_threads=1)) for x in texts]


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer version: the file's content and the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = tokenizers if path.endswith(".json") else sentencepiece
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__}|{library.__version__}".encode()).hexdigest()


def _count(path: str, batch_texts: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [k for at in range(0, len(texts), batch_texts) for k in count(texts[at : at + batch_texts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache at ``path``, None where there is none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text.

    ``tokenizer`` is the path of the vocabulary file, the same on every executor; ``cache`` the path of the cache in a
    shared folder, a new one if not given. The normal form is the text itself with null as empty: any other would give
    texts with different counts one digest. An empty text has no tokens. Ids may be null or repeat; other columns are
    not carried. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path, version = cache or scratch(spark, "token-cache"), tokenizer_digest(tokenizer)
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))
    misses = own.groupBy("digest").agg(F.first("text").alias("text"))
    if (stored := read_cache(spark, path)) is not None:
        misses = misses.join(stored.where(F.col("tokenizer") == version).select("digest"), "digest", "left_anti")
    fresh = misses.select("digest", "text").mapInArrow(_count(tokenizer), "digest string, n_tokens bigint")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(path)
    counts = read_cache(spark, path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")) if stored is not None else counts
    sized = own.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
