"""Context-triggered piecewise hashing: document fingerprints and their likeness.

A rolling hash of the last ``WINDOW`` bytes ends a chunk where it is -1 modulo the block size, so that the ends depend
on the bytes near them alone. Each chunk is hashed to two characters of a 64-letter alphabet. Block sizes are powers of
two times ``LEAST``; a fingerprint has the chunk signatures of one block size and of twice that. Two fingerprints are
compared at a block size that both have, by the edit distance (insertions and deletions) of their chunk sequences.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, partitions

WINDOW = 7
LEAST = 4
#: Chunks that the block size is chosen for.
CHUNKS = 48
#: The alphabet of the signatures.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in LETTERS for b in LETTERS]


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: a function of the ``WINDOW`` bytes up to it (zeros before the first)."""
    x = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)))
    n, out = len(data), np.zeros(len(data), np.uint32)
    for k in range(WINDOW):  # a polynomial over the window, oldest byte first
        out *= np.uint32(0x01000193)
        out += x[k : k + n]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def _signature(data: bytes, hashes: np.ndarray, block: int) -> str:
    ends = (np.flatnonzero(hashes & np.uint32(block - 1) == block - 1) + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    crc, pairs, start, out = zlib.crc32, _PAIRS, 0, []
    for end in ends:
        out.append(pairs[crc(data[start:end]) >> 20])
        start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``; empty texts have ``LEAST`` and empty signatures."""
    data = text.encode("utf-8", "replace")
    if not data:
        return f"{LEAST}::"
    hashes, block = rolling(np.frombuffer(data, np.uint8)), LEAST
    while block * CHUNKS < len(data):
        block *= 2
    return f"{block}:{_signature(data, hashes, block)}:{_signature(data, hashes, 2 * block)}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two signatures' chunks, one bit of an integer for each of ``a``."""
    where: dict[str, int] = {}
    for i in range(0, len(a), 2):
        where[c] = where.get(c := a[i : i + 2], 0) | 1 << i // 2
    n = len(a) // 2
    row = full = (1 << n) - 1
    for j in range(0, len(b), 2):
        hit = row & where.get(b[j : j + 2], 0)
        if hit:
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def likeness(a: str, b: str) -> float:
    """1 less the edit distance over the chunks of both, at the block size that both have; 1 for equal fingerprints, 0 for none."""
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    best = 0.0
    for i in (1, 2):
        for j in (1, 2):
            if int(x[0]) * i == int(y[0]) * j and x[i] and y[j]:
                total = (len(x[i]) + len(y[j])) // 2
                best = max(best, 2 * common(x[i], y[j]) / total)
    return best


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down, in code points) replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, guest, doc_id, text), sorted: each document with the next row of its bucket."""
    held = None  # the last row: bucket, doc_id, text, fingerprint
    for batch in batches:
        out: list[tuple] = []
        for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = fingerprint(text)
            if held is not None and held[0] == bucket:
                text_, fp = held[2], held[3]
                new = edited(text_, text)
                fp_new = fingerprint(new)
                out.append((held[1], len(text_), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), fp, fp_new, likeness(fp, fp_new), likeness(fp, own)))
            held = None if guest else (bucket, doc_id, text, own)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=_NAMES)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint) of each whole text. Null counts as empty; equal texts have equal fingerprints."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x or "") for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=[id_col, "fingerprint"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document.

    The next document is that with the next doc_id; the last one's is the first. Texts cross the network once: doc_ids
    are cut into ranges at their quantiles, rows are dealt by range and sorted there, and the first row of each range
    also goes to the range before it as a guest. Null texts count as empty. Rows that repeat a doc_id follow each other
    in the order of their texts; rows with a null doc_id come first. Other columns are not carried. One row alone is its
    own next document; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = own.select("doc_id").where("doc_id is not null")
    ranges = 4 * partitions(spark)
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.expr("0" if not cuts else f"case when doc_id is null then 0 else {_search(cuts, 'doc_id')} end").cast("int")
    key = F.struct("doc_id", F.sha2("text", 256).alias("digest"))  # nulls come first
    first = own.withColumn("bucket", place).groupBy("bucket").agg(F.min(key).alias("k"), F.count("*").alias("n")).orderBy("bucket").collect()
    if not first:
        return spark.createDataFrame([], _SCHEMA)
    before = {b["bucket"]: first[k - 1]["bucket"] for k, b in enumerate(first)}  # at most ``ranges`` entries; the first range's goes to the last
    guests = spark.createDataFrame([(b["bucket"], before[b["bucket"]], b["k"]["doc_id"], b["k"]["digest"]) for b in first], "bucket int, to int, first bigint, digest string")
    rows = own.withColumn("bucket", place).select("bucket", F.lit(0).alias("guest"), "doc_id", "text", F.sha2("text", 256).alias("digest"))
    heads = rows.join(F.broadcast(guests), (rows["bucket"] == guests["bucket"]) & rows["doc_id"].eqNullSafe(guests["first"]) & (rows["digest"] == guests["digest"]))
    heads = heads.select(F.col("to").alias("bucket"), F.lit(1).alias("guest"), rows["doc_id"], "text", rows["digest"]).dropDuplicates(["bucket"])
    dealt = rows.unionByName(heads).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "digest")
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(_pairs, _SCHEMA)


def _search(cuts: list[int], column: str, low: int = 0) -> str:
    """SQL for the number of cuts that are less than or equal to ``column``, by halving."""
    if not cuts:
        return str(low)
    mid = len(cuts) // 2
    return f"if({column} >= {cuts[mid]}, {_search(cuts[mid + 1 :], column, low + mid + 1)}, {_search(cuts[:mid], column, low)})"
