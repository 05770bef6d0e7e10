"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers, floor(256 x). Candidates lie in blocks in vertical layout: one array for each dimension. A
query adds up its scores over a block of dimensions at a time; what the dimensions still to come can add is at most the
product of the remaining norms (Cauchy-Schwarz), so candidates whose bound falls below the k-th best score that is
already certain are dropped and the survivors' columns compacted.

Blocks of candidates are packed and written once, in integers no wider than the components need, and stay where they
are: a bounded set of queries at a time goes to them by a broadcast. A task carries each query's best scores so far from
block to block, so later blocks are pruned by all the earlier ones, and hands on ``k`` rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, partitions

SCALE = 256
CANDIDATES = 16384
#: Bytes of packed queries that go to the candidates at once: the size bound of the broadcast.
QUERY_BYTES = 4 << 20
DIMS = 8


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<bigint>): floor(256 x) of each component as double; rows with nulls, infinities or NaNs, a null id or a null vector are left out."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _kind(most: int) -> str:
    """The narrowest integer type for components of an absolute value of at most ``most``."""
    return "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"


def _packed(names: list[str], kind: str):
    """Rows of one key as one row: ids, and the components dimension by dimension, as bytes."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        width = len(t["v"][0])
        m = np.concatenate([np.asarray(c.flatten()) for c in t["v"].chunks]).reshape(len(ids), width).astype(kind)
        return pa.table({**{n: pa.array([k.as_py()], pa.int64()) for n, k in zip(names, key, strict=True)}, "ids": pa.array([ids.tobytes()], pa.binary()), "cols": pa.array([np.ascontiguousarray(m.T).tobytes()], pa.binary())})

    return run


def search_block(query: np.ndarray, own: int, ids: np.ndarray, cols: np.ndarray, tails: np.ndarray, k: int, dims: int = DIMS, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the ``k`` best candidates for one query, ties to the smaller id; ``own`` is not a candidate.

    ``cols``: (dimensions, candidates), ``tails``: the norm of each candidate over the dimensions from 0, ``dims``, 2 ``dims``, ... on.
    ``known``: a score that ``k`` candidates of other blocks reach; those below it are left out.
    """
    width = len(query)
    left = np.sqrt(np.cumsum((query.astype(np.float64) ** 2)[::-1]))[::-1]
    other = ids != own
    live = None if other.all() else np.flatnonzero(other)  # columns that survive; None: all
    part = np.zeros(cols.shape[1] if live is None else len(live), np.result_type(cols.dtype, np.int64))
    for step, at in enumerate(range(0, width, dims)):
        block = cols[at : at + dims] if live is None else cols[at : at + dims, live]
        part = part + query[at : at + dims] @ block
        if at + dims >= width or not len(part) or (len(part) <= k and known == -np.inf):
            continue
        tail = tails[step + 1] if live is None else tails[step + 1, live]
        rest = left[at + dims] * tail * (1 + 1e-9) + 1
        floor_ = max(known, np.partition(part - rest, len(part) - k)[len(part) - k]) if len(part) > k else known
        keep = np.flatnonzero(part + rest >= floor_)
        if len(keep) < len(part):
            live, part = keep if live is None else live[keep], part[keep]
    found = ids if live is None else ids[live]
    if len(part) > k:
        known = max(known, np.partition(part, len(part) - k)[len(part) - k])
    if len(part):
        at_least = part >= known
        found, part = found[at_least], part[at_least]
    order = np.lexsort((found, -part))[:k]
    return part[order].astype(np.int64), found[order]


def _search(k: int, kind: str):
    """Rows (width, q_ids, q_cols, ids, cols) in, the ``k`` best of all blocks of a task for each query out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                width, q_ids, q_cols, ids, cols = (batch.column(c)[row].as_py() for c in range(5))
                if width not in asked:
                    qids = np.frombuffer(q_ids, np.int64)
                    q = np.ascontiguousarray(np.frombuffer(q_cols, kind).reshape(-1, len(qids)).T)
                    asked[width] = qids, q, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
                qids, q, best = asked[width]
                ids = np.frombuffer(ids, np.int64)
                cols = np.frombuffer(cols, kind).reshape(-1, len(ids))
                reach = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(cols.astype(float)).max(initial=0)) * max(1, width)
                if reach >= 2.0**62:
                    raise OverflowError("the inner products do not fit in 64 bits")
                exact = "float64" if reach < 2.0**53 else "int64"  # sums of integers below 2^53 are exact in doubles
                cols, queries = cols.astype(exact), q.astype(exact)
                sums = np.cumsum(cols[::-1].astype(np.float64) ** 2, axis=0)[::-1]
                tails = np.sqrt(sums[::DIMS])
                for j, qid in enumerate(qids.tolist()):
                    s, i = best[j]
                    scores, found = search_block(queries[j], qid, ids, cols, tails, k, known=float(s[-1]) if len(s) == k and reach < 2.0**53 else -np.inf)
                    if len(s):
                        scores, found = np.concatenate((s, scores)), np.concatenate((i, found))
                        order = np.lexsort((found, -scores))[:k]
                        scores, found = scores[order], found[order]
                    best[j] = scores, found
        for qids, _, best in asked.values():
            n = [len(s) for s, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", candidates: int = CANDIDATES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each row whose id is divisible by ``every``.

    All rows but the query's own are candidates; ties go to the smaller id; a query with fewer candidates returns them
    all. Vectors of another length than the query's are no candidates of it. Rows that ``integer_vectors`` leaves out
    take no part. Rows with a repeated id are candidates each (and none for a query of that id); of queries with one id
    each counts. An empty table gives an empty result. Candidates are shuffled once; queries meet them in sets of about
    ``query_bytes``, each in a pass over the packed blocks.
    """
    spark = vectors.sparkSession
    ints = materialise(integer_vectors(vectors, id_col, vec_col).withColumn("width", F.size("v").cast("long")).where("width > 0"), "vectors")
    most = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    n, m, width, largest = ints.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max("width"), F.max(most)).first()
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not m:
        return none
    kind = _kind(largest)
    blocks = max(1, -(-n // candidates), min(partitions(spark), -(-n // 4096)))
    packed = "width bigint, part bigint, ids binary, cols binary"
    cand = ints.groupBy("width", F.expr(f"pmod(xxhash64(id, v), {blocks})").alias("part")).applyInArrow(_packed(["width", "part"], kind), packed)
    cand = materialise(cand, "candidates", maxRecordsPerFile=1)
    sets = -(-m * width * np.dtype(kind).itemsize // query_bytes)
    asks = ints.where(F.col("id") % every == 0).groupBy("width", F.expr(f"pmod(xxhash64(id, v, 1), {sets})").alias("part")).applyInArrow(_packed(["width", "part"], kind), packed)
    asks, found = materialise(asks, "queries"), []
    for part in range(sets):
        few = asks.where(F.col("part") == part).select("width", F.col("ids").alias("q_ids"), F.col("cols").alias("q_cols"))
        met = cand.join(F.broadcast(few), "width").select("width", "q_ids", "q_cols", "ids", "cols")  # about ``query_bytes``
        found.append(materialise(met.mapInArrow(_search(k, kind), "query_id bigint, vec_id bigint, score bigint"), "found"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
