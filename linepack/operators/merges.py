"""Byte-pair merges of a corpus, many a round, as if they were made one at a time.

The work is on the distinct words, spread over the cluster as arrays of symbols. A round rewrites them and
makes two small aggregations: the most frequent pairs, what stands left and right of those that were likely to be among
them, and then all merges that follow from these figures. The driver replays the merges on its few pairs: what a merge takes from other pairs and what pairs it makes are
sums of those contexts. Where a merge changes the context of another, the sums become upper bounds; as soon as a bound
could be the next pair, or one that is not among the counted, the round ends. So the result is that of one merge after the
other, and the driver holds ``candidates`` pairs with their neighbours, whatever the size of the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

Merge = tuple[int, int, int]
NO, PURE, TRAIL, INVALID = range(4)
#: Class of a merge by those of its parts: newlines only at the end of a token.
_JOINED = [[NO, TRAIL, TRAIL, INVALID], [INVALID, PURE, INVALID, INVALID], [INVALID, TRAIL, INVALID, INVALID], [INVALID] * 4]


def byte_classes() -> list[int]:
    """Newline classes of the 256 bytes: a newline or carriage return is PURE."""
    return [PURE if b in (10, 13) else NO for b in range(256)]


def joined_class(a: int, b: int) -> int:
    return _JOINED[a][b]


class _Batch:
    """The symbols of (n, s) rows: flat, the row of each, and the weight of each row."""

    def __init__(self, batch: pa.RecordBatch):
        self.flat = batch.column(1).flatten().to_numpy().astype(np.int64)
        sizes = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
        self.n, self.row = batch.column(0).to_numpy(), np.repeat(np.arange(len(sizes)), sizes)

    def pairs(self) -> np.ndarray:
        """Places whose next one is in the same row."""
        return np.flatnonzero(self.row[:-1] == self.row[1:])

    def merge(self, a: int, b: int, new: int) -> None:
        """Left to right; in a run of one symbol every second place counts."""
        flat, row = self.flat, self.row
        hits = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b) & (row[:-1] == row[1:]))
        if not len(hits):
            return
        if a == b:
            begins = np.append(True, np.diff(hits) != 1)
            first = np.maximum.accumulate(np.where(begins, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
        flat[hits] = new
        stay = np.ones(len(flat), bool)
        stay[hits + 1] = False
        self.flat, self.row = flat[stay], row[stay]


    def merge_all(self, merges: list[Merge], old: np.ndarray) -> None:
        """All ``merges`` in turn, in the rows that have one of their pairs (sorted in ``old``)."""
        at = self.pairs()
        own = self.flat[at] << 32 | self.flat[at + 1]
        hit = at[old[np.minimum(np.searchsorted(old, own), len(old) - 1)] == own]
        if not len(hit):
            return
        touched = np.zeros(len(self.n), bool)
        touched[self.row[hit]] = True
        mine = touched[self.row]
        rest, rest_row = self.flat[~mine], self.row[~mine]
        self.flat, self.row = self.flat[mine], self.row[mine]
        for m in merges:
            self.merge(*m)
        flat, row = np.concatenate((rest, self.flat)), np.concatenate((rest_row, self.row))
        order = np.argsort(row, kind="stable")
        self.flat, self.row = flat[order], row[order]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.add.reduceat(weights, at) if len(at) else np.zeros(0, np.int64)


class _Sums:
    """Sums of weights by key: dense while keys are few, else sorted batch by batch."""

    def __init__(self, keys: int):
        self.dense = np.zeros(keys, np.int64) if keys <= 1 << 24 else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        if self.dense is not None:
            np.add.at(self.dense, keys, weights)
            return
        found, n = _summed(keys, weights)
        self.parts.append((found, n))
        self.size += len(found)
        if self.size > 1 << 21:
            self.parts = [self.all()]
            self.size = len(self.parts[0][0]) // 2  # so that sums of many keys are not made anew each time

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            found = np.flatnonzero(self.dense)
            return found, self.dense[found]
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


#: Kinds of rows of a round: words, counts of pairs, counts of the neighbours of pairs.
WORDS, PAIRS, NEAR = range(3)


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, s): words as the bytes of their UTF-8; those of one byte have no pair and go."""
    for batch in batches:
        words = batch.column(1).cast(pa.binary())
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        data, at = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
        flat = np.frombuffer(data, np.uint8)[at : at + ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["n", "s"]).filter(pa.array(sizes > 1))


def _neighbours(b: _Batch, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (pair, side, other) and weights of the symbols before (0) and behind (1) each of the pairs with sorted ``keys``."""
    at = b.pairs()
    own = b.flat[at] << 32 | b.flat[at + 1]
    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    hit = keys[place] == own
    at, which = at[hit], order[place[hit]]
    found, weight = [], []
    for side, other in ((0, at - 1), (1, at + 2)):
        near = (other >= 0) & (other < len(b.flat))
        near[near] = b.row[other[near]] == b.row[at[near]]
        found.append((which[near] * 2 + side) << 32 | b.flat[other[near]])
        weight.append(b.n[b.row[at[near]]])
    return np.concatenate(found), np.concatenate(weight)


def _sorted_keys(wanted: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([a << 32 | b for a, b in wanted], np.int64)
    order = np.argsort(keys)
    return keys[order], order


def _good_pairs(b: _Batch, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right symbols of adjacent places and their weights; pairs that the classes refuse are left out."""
    at = b.pairs()
    left, right = b.flat[at], b.flat[at + 1]
    if known is not None:
        good = np.array(_JOINED)[known[left], known[right]] != INVALID
        at, left, right = at[good], left[good], right[good]
    return left, right, b.n[b.row[at]]


def _word_rows(b: _Batch, n: pa.Array) -> pa.RecordBatch:
    """(n, s) of the batch as it is now; rows of one symbol are done and go."""
    sizes = np.bincount(b.row, minlength=len(n))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(b.flat.astype(np.int32)))
    return pa.RecordBatch.from_arrays([n, lists], names=["n", "s"]).filter(pa.array(sizes > 1))


def _pair_counts(classes: np.ndarray | None):
    """(l, r, n) of adjacent symbols, summed within a batch: the counting of a round alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, weights = _good_pairs(_Batch(batch), classes)
            keys, n = _summed(left << 32 | right, weights)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["l", "r", "n"])

    return run


def _contexts(wanted: list[tuple[int, int]]):
    """(pair, side, other, n): the symbols before (0) and behind (1) each of the ``wanted`` pairs, summed within a batch."""
    keys, order = _sorted_keys(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = _summed(*_neighbours(_Batch(batch), keys, order))
            cols = [(sums >> 33).astype(np.int32), (sums >> 32 & 1).astype(np.int32), (sums & 0xFFFFFFFF).astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["pair", "side", "other", "n"])

    return run


def _rewritten(merges: list[Merge]):
    """Rows after ``merges`` in turn: the rewriting of a round alone."""
    old = _sorted_keys([m[:2] for m in merges])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch)
            b.merge_all(merges, old)
            yield _word_rows(b, batch.column(0))

    return run


def _round(merges: list[Merge], classes: list[int] | None, wanted: list[tuple[int, int]], symbols: int):
    """(kind, n, s): the words after ``merges`` in turn, and behind them the task's counts of their pairs and of the neighbours of ``wanted``.

    Only words with one of the merged pairs are rewritten; a merge of this round's symbols needs an earlier one there. Words
    of one symbol are done and go, and so do pairs that ``classes`` refuse. Ids are below ``symbols``.
    """
    known = None if classes is None else np.array(classes)
    old = _sorted_keys([m[:2] for m in merges])[0]
    keys, order = _sorted_keys(wanted)

    def counted(kind: int, sums: _Sums, parts) -> Iterator[pa.RecordBatch]:
        found, n = sums.all()
        for at in range(0, len(found), 10_000):
            cols = parts(found[at : at + 10_000])
            flat = np.stack(cols, axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(cols)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), kind, np.int32)), pa.array(n[at : at + 10_000]), lists], names=["kind", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, near = _Sums(symbols * symbols), _Sums(2 * len(keys) * symbols)
        for batch in batches:
            b = _Batch(batch)
            if len(old):
                b.merge_all(merges, old)
            left, right, weights = _good_pairs(b, known)
            pairs.add(left * symbols + right, weights)
            if len(keys):
                around, weights = _neighbours(b, keys, order)
                near.add((around >> 32) * symbols + (around & 0xFFFFFFFF), weights)
            rows = _word_rows(b, batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, WORDS, np.int32)), *rows.columns], names=["kind", "n", "s"])
        yield from counted(PAIRS, pairs, lambda k: (k // symbols, k % symbols))
        yield from counted(NEAR, near, lambda k: (k // symbols >> 1, k // symbols & 1, k % symbols))

    return run


class Replay:
    """The merges that follow from the counts of the most frequent pairs and their contexts.

    ``top`` are (count, left, right), most frequent first; ``more`` says whether other pairs exist, none before the last of
    ``top``. ``near[pair]`` are the counts of symbols left and right of it. A count is exact or an upper bound.
    """

    def __init__(self, top: list[tuple[int, int, int]], more: bool, near: dict[tuple[int, int], tuple[dict[int, int], dict[int, int]]], classes: list[int] | None):
        self.count = {(a, b): n for n, a, b in top}
        self.bound: set[tuple[int, int]] = set()
        self.near, self.classes = near, classes
        self.vague: dict[tuple[int, int], tuple[set[int], set[int]]] = {p: (set(), set()) for p in near}
        self.last = (-top[-1][0], top[-1][1], top[-1][2]) if more else None
        self.heap = [(-n, a, b) for n, a, b in top]
        heapq.heapify(self.heap)

    def guess(self, most: int) -> list[tuple[int, int]]:
        """Pairs of two symbols that may come next, by their counts or bounds."""
        return heapq.nsmallest(most, (p for p, n in self.count.items() if n > 0 and p[0] != p[1]), key=lambda p: (-self.count[p], p))

    def _put(self, pair: tuple[int, int], n: int, exact: bool) -> None:
        if n <= 0 or self.classes is not None and joined_class(self.classes[pair[0]], self.classes[pair[1]]) == INVALID:
            return
        self.count[pair] = max(n, self.count.get(pair, 0))
        if not exact:
            self.bound.add(pair)
        heapq.heappush(self.heap, (-self.count[pair], *pair))

    def _less(self, pair: tuple[int, int], n: int, exact: bool) -> None:
        if pair not in self.count:
            return  # it was below the last of the counted pairs and falls
        if exact:
            self.count[pair] -= n
            heapq.heappush(self.heap, (-self.count[pair], *pair))
        else:
            self.bound.add(pair)

    def merges(self, first: int, most: int) -> list[Merge]:
        """Up to ``most`` merges with ids from ``first`` on; one at least if any pair is left."""
        out: list[Merge] = []
        while self.heap and len(out) < most:
            key = heapq.heappop(self.heap)
            pair = key[1:]
            if self.count.get(pair) != -key[0]:
                continue  # an older entry
            if key[0] >= 0 or pair in self.bound or self.last is not None and key > self.last:
                break
            a, b = pair
            new = first + len(out)
            out.append((a, b, new))
            if self.classes is not None:
                self.classes.append(joined_class(self.classes[a], self.classes[b]))
            del self.count[pair]
            if a == b or pair not in self.near:
                break  # its neighbours are not known
            self._apply(a, b, new)
        return out

    def _apply(self, a: int, b: int, new: int) -> None:
        (left, right), (vague_left, vague_right) = self.near.pop((a, b)), self.vague.pop((a, b))
        for c, n in left.items():
            exact = c not in vague_left and c != b
            self._less((c, a), n, exact)
            self._put((c, new), n, exact)
        for d, n in right.items():
            exact = d not in vague_right and d != a
            self._less((b, d), n, exact)
            self._put((new, d), n, exact)
        self._put((new, new), min(right.get(a, 0), left.get(b, 0)), False)
        for (e, f), (before, behind) in self.near.items():
            vague_before, vague_behind = self.vague[e, f]
            if e == b:  # those behind an ``a`` are gone, and of what stood behind them one knows no more than that
                before.pop(a, None)
                vague_behind.update(behind)
            if f == a:
                behind.pop(b, None)
                vague_before.update(before)
            if (n := min(before.get(b, 0), right.get(e, 0))) > 0:
                vague_before.update((b, new))
                before[new] = n
            if (n := min(behind.get(a, 0), left.get(f, 0))) > 0:
                vague_behind.update((a, new))
                behind[new] = n


def train_bpe(words: DataFrame, n_merges: int, candidates: int = 384, cut_every: int = 8, protect_newlines: bool = False) -> list[Merge]:
    """The merges (left, right, new id from 256 on) of the most frequent pairs, ties to the smaller pair, in order.

    ``words`` has the distinct words (word, n). With ``protect_newlines`` a merge that would put a newline anywhere but at
    the end of a token is refused, so every token is NO, PURE or TRAIL. A round goes over the words once: it rewrites them,
    counts their pairs, and the neighbours of those pairs that the round before takes for the next ones; a merge whose
    neighbours were not counted ends its round. The state is persisted from round to round, and every ``cut_every`` rounds
    it is checkpointed: lineage stays short, and a lost executor costs some rounds' rewrites.
    """
    spark = words.sparkSession
    classes = byte_classes() if protect_newlines else None
    state = words.where(F.octet_length("word") > 1).select(F.col("n").cast("bigint").alias("n"), "word").mapInArrow(_symbols, "n bigint, s array<int>")
    merges: list[Merge] = []
    taken: list[Merge] = []
    wanted: list[tuple[int, int]] = []
    rounds, last = 0, None
    while len(merges) < n_merges:
        made = state.mapInArrow(_round(taken, classes, wanted, 256 + len(merges)), "kind int, n bigint, s array<int>").persist()
        part = lambda i: F.get("s", F.lit(i))
        pairs = made.where(F.col("kind") == PAIRS).groupBy(part(0).alias("l"), part(1).alias("r")).agg(F.sum("n").alias("n"))
        top = [(r["n"], r["l"], r["r"]) for r in pairs.orderBy(F.desc("n"), "l", "r").limit(candidates).collect()]
        if last is not None:  # the state has been filled from it by now
            last.unpersist()
        last, state = made, made.where(F.col("kind") == WORDS).select("n", "s")
        if not top:
            break
        if wanted:
            around = made.where(F.col("kind") == NEAR)
        else:  # the first round knows no pairs before
            wanted = [(a, b) for _, a, b in top if a != b]
            around = state.mapInArrow(_round([], classes, wanted, 256 + len(merges)), "kind int, n bigint, s array<int>").where(F.col("kind") == NEAR) if wanted else None
        near: dict[tuple[int, int], tuple[dict[int, int], dict[int, int]]] = {p: ({}, {}) for p in wanted}
        if around is not None:
            for r in around.groupBy(part(0).alias("pair"), part(1).alias("side"), part(2).alias("other")).agg(F.sum("n").alias("n")).collect():  # of some times ``candidates`` pairs
                near[wanted[r["pair"]]][r["side"]][r["other"]] = r["n"]
        replay = Replay(top, len(top) == candidates, near, classes)
        taken = replay.merges(256 + len(merges), n_merges - len(merges))
        wanted = replay.guess(2 * candidates)
        merges += taken
        rounds += 1
        if rounds % cut_every == 0:
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(shared_path(spark, "bpe"))
            state = state.checkpoint()
    if last is not None:
        last.unpersist()
    return merges


def write_merges(spark: SparkSession, merges: list[Merge], path: str) -> None:
    """Store merges in order: a row each, in one file, as a vocabulary is small."""
    rows = [(i, *m) for i, m in enumerate(merges)]
    spark.createDataFrame(rows, "rank int, l int, r int, new int").coalesce(1).write.mode("overwrite").parquet(path)


def read_merges(spark: SparkSession, path: str) -> list[Merge]:
    return [(r["l"], r["r"], r["new"]) for r in spark.read.parquet(path).orderBy("rank").collect()]


def token_classes(merges: list[Merge]) -> list[int]:
    """Newline classes of all tokens by id."""
    classes = byte_classes()
    for a, b, _ in merges:
        classes.append(joined_class(classes[a], classes[b]))
    return classes
