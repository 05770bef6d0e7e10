"""Byte-pair vocabularies at corpus scale: word counts, ids, encoding, reports; ``merges`` learns them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merges import Merge, train_bpe  # noqa: F401

#: Fixed value: the split pattern; ``(?U)`` gives Java the Unicode meaning of white space.
PATTERN = r"(?U)'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def pretokenize(col: Column) -> Column:
    """The text's words in order; joined they are the text."""
    return F.regexp_extract_all(col, F.lit(PATTERN), F.lit(0))


def word_counts(df: DataFrame, words: Column) -> DataFrame:
    """(word, n): summed within tasks before the shuffle."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def build_vocab(df: DataFrame, specials: list[str]) -> DataFrame:
    """(id, token, is_special) from (rank, token): tokens keep their rank as id, specials follow in list order."""
    tokens = df.select(F.col("rank").cast("int").alias("id"), "token", F.lit(False).alias("is_special"))
    n = df.count()
    named = df.sparkSession.createDataFrame([(n + k, s, True) for k, s in enumerate(specials)], "id int, token string, is_special boolean")
    return tokens.unionByName(named)


def extend_vocab(vocab: DataFrame, names: list[str]) -> DataFrame:
    """Add the specials that are missing after the largest id; no id moves."""
    wanted = vocab.sparkSession.createDataFrame(list(enumerate(names)), "ord int, token string")
    missing = wanted.join(vocab.where("is_special").select("token"), "token", "left_anti")
    top = vocab.agg(F.max("id").alias("top"))
    new = missing.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy("ord"))).cast("int").alias("id"), "token", F.lit(True).alias("is_special"))  # a few names, one row
    return vocab.unionByName(new)


def token_bytes(vocab: DataFrame) -> DataFrame:
    """(id, n_bytes): UTF-8 bytes of a token, 0 for specials."""
    return vocab.select("id", F.when(F.col("is_special"), 0).otherwise(F.octet_length("token")).alias("n_bytes"))


def token_bytes_stats(lengths: DataFrame) -> DataFrame:
    x = F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    return lengths.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def newline_class(token: Column) -> Column:
    """NO: no newline; PURE: only newlines; TRAIL: no newline but a run at its end; else INVALID."""
    return F.when(~token.rlike(r"[\n\r]"), "NO").when(token.rlike(r"^[\n\r]+$"), "PURE").when(token.rlike(r"^[^\n\r]+[\n\r]+$"), "TRAIL").otherwise("INVALID")


def check_vocab(vocab: DataFrame) -> None:
    """Raise if a token (string or bytes) breaks lines inside, or no token is a newline alone."""
    token = F.decode("token", "ISO-8859-1") if dict(vocab.dtypes)["token"] == "binary" else F.col("token")
    bad = vocab.where(~F.col("is_special") & (newline_class(token) == "INVALID")).limit(5).collect()
    if bad:
        raise ValueError(f"tokens with newlines inside: {[r['token'] for r in bad]}")
    if vocab.where(~F.col("is_special") & (newline_class(token) == "PURE")).isEmpty():
        raise ValueError("no token is a newline alone")


#: Characters of words that an encoder remembers, and of texts that it encodes at once besides those of one row.
ROOM, AT_ONCE = 16 << 20, 4 << 20


class _Encoder:
    """Ids of words by ``merges``; a word is encoded once and remembered while there is room."""

    def __init__(self, merges: list[Merge]):
        self.ranks, self.known, self.held = {(a, b): new for a, b, new in merges}, {}, 0

    def word(self, word: str) -> np.ndarray:
        ids, rank = list(word.encode("utf-8", "replace")), self.ranks.get
        around = [rank(p, _NONE) for p in zip(ids, ids[1:])]  # noqa: B905
        while around and (least := min(around)) < _NONE:
            k = around.index(least)
            ids[k : k + 2] = [least]
            around[max(k - 1, 0) : k + 2] = [rank((ids[j], ids[j + 1]), _NONE) for j in range(max(k - 1, 0), min(k + 1, len(ids) - 1))]
        return np.array(ids, np.int32)

    def rows(self, words: pa.ListArray) -> pa.ListArray:
        """The ids of each row of words: distinct words are encoded, rows gather them."""
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        if not self.ranks:  # bytes are the ids
            text = words.flatten().cast(pa.binary())
            ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
            raw = np.frombuffer(b"".join(x for x in text.to_pylist() if x), np.uint8)
            return pa.ListArray.from_arrays(pa.array(ends[np.append(0, np.cumsum(counts))].astype(np.int32)), pa.array(raw.astype(np.int32)))
        coded = words.flatten().dictionary_encode()
        if len(self.known) > 500_000 or self.held > ROOM:
            self.known.clear()
            self.held = 0
        distinct = coded.dictionary.to_pylist()
        for w in distinct:
            if w not in self.known:
                self.known[w] = self.word(w)
                self.held += len(w)
        parts = [self.known[w] for w in distinct]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat, first = np.concatenate([*parts, np.zeros(0, np.int32)]), np.cumsum(size) - size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = size[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)), pa.array(ids))


_NONE = 1 << 30


def encode(df: DataFrame, words: Column, merges: list[Merge], key: str = "doc_id", first: int | None = None, backwards: bool = False) -> DataFrame:
    """(key, ids): each text's words in ids of ``merges``; ``first`` goes before them, also when they are reversed.

    The distinct words of a batch are encoded once, and documents gather their ids from them; nothing is shuffled. A null
    text has no ids of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(merges)
        for batch in batches:
            each = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)))
            size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1).flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)))[each]
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, size[at] + AT_ONCE, side="right")) - 1)
                some = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([some.column(0), encoder.rows(some.column(1))], names=[key, "ids"])
                at = end

    out = df.select(key, words.alias("w")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")
    ids = F.reverse("ids") if backwards else F.col("ids")
    return out.select(key, (F.concat(F.array(F.lit(first)), ids) if first is not None else ids).alias("ids"))


def merged_vocab(spark: SparkSession, merges: list[Merge], specials: list[str]) -> DataFrame:
    """(id, token as bytes, is_special): bytes and merges by id, specials behind them in list order."""
    tokens = [(i, bytearray(x), False) for i, x in enumerate(vocab_bytes(merges))]
    return spark.createDataFrame(tokens + [(len(tokens) + k, bytearray(x.encode()), True) for k, x in enumerate(specials)], "id int, token binary, is_special boolean")


def vocab_bytes(merges: list[Merge]) -> list[bytes]:
    table = [bytes([b]) for b in range(256)]
    for a, b, _ in merges:
        table.append(table[a] + table[b])
    return table


def decode(df: DataFrame, merges: list[Merge], ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of the ids; ids that are no token add nothing."""
    table = vocab_bytes(merges)

    @F.pandas_udf("string")
    def text(col):
        return col.map(lambda x: b"".join(table[i] for i in x if i < len(table)).decode("utf-8", "replace"))

    return df.withColumn("decoded", text(ids))


def compression_report(df: DataFrame, group: str, text: Column, n_tokens: Column) -> DataFrame:
    """(group, bytes, tokens, bytes_per_token)."""
    out = df.groupBy(group).agg(F.sum(F.octet_length(text)).alias("bytes"), F.sum(n_tokens).cast("bigint").alias("tokens"))
    return out.withColumn("bytes_per_token", F.try_divide("bytes", "tokens"))


def compare_tokenizers(base: DataFrame, ours: DataFrame, group: str) -> DataFrame:
    """(group, base_tokens, our_tokens, relative in percent, winner by bytes a token)."""
    both = base.select(group, F.col("tokens").alias("base_tokens")).join(ours.select(group, F.col("tokens").alias("our_tokens")), group)
    rel = (F.col("base_tokens") - F.col("our_tokens")) * 100.0 / F.col("base_tokens")
    return both.withColumn("relative", rel).withColumn("winner", F.when(rel > 0, "ours").when(rel < 0, "base").otherwise("tie"))
