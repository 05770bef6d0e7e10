"""Packing of documents into rows of fixed length, in the order of each shard, and assembly of the rows.

Packing is greedy and follows the order of its input, so it runs shard by shard, shards in parallel. Lengths alone
decide, so (key, length) is packed and payloads are joined later. A task holds one buffer of documents. Payloads meet
their places in one join, are dealt out by row and written into rows of arrays batch by batch; no row is collected.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NONE = float("inf")
#: Documents whose rows a task writes at once, besides those of one row.
AT_ONCE = 500


class _Shard:
    """Rows of one shard. The buffer is sorted by (length, -arrival): equal lengths leave in order of arrival."""

    def __init__(self, capacity: int, crop: bool):
        self.capacity, self.crop, self.buffer, self.row, self.room, self.part, self.arrived = capacity, crop, [], 0, capacity, 0, 0

    def add(self, key: int, length: int) -> None:
        insort(self.buffer, (length, -self.arrived, key))
        self.arrived += 1

    def _close(self) -> None:
        self.row, self.room, self.part = self.row + 1, self.capacity, 0

    def place(self) -> tuple:
        """One step: the largest document that fits; else the shortest one cropped, or the row closed."""
        k = bisect_right(self.buffer, (self.room, _NONE)) - 1
        if k < 0:
            if not self.crop:
                self._close()
                return ()
            k = bisect_right(self.buffer, (self.buffer[0][0], _NONE)) - 1
        length, _, key = self.buffer.pop(k)
        used = min(length, self.room)
        out = (self.row, self.part, key, self.capacity - self.room, used, length - used)
        self.room, self.part = self.room - used, self.part + 1
        if not self.room:
            self._close()
        return out


def _pack(df: DataFrame, capacity: int, shard: str, key: str, length: str, order: str, buffer: int, crop: bool) -> DataFrame:
    """Places of documents of some length; shards and orders are not null, keys of a shard have distinct orders."""
    names = [shard, "row", "part", key, "offset", "used", "lost"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, name = None, None
        for frame in frames:
            out = []
            for s, k, n in zip(frame[shard], frame[key], frame[length], strict=True):
                if state is None or s != name:
                    while state is not None and state.buffer:
                        if got := state.place():
                            out.append((name, *got))
                    state, name = _Shard(capacity, crop), s
                while len(state.buffer) >= buffer:  # full before every pick
                    if got := state.place():
                        out.append((name, *got))
                state.add(k, n)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            out = []
            while state.buffer:
                if got := state.place():
                    out.append((name, *got))
            yield pd.DataFrame(out, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"{shard} {kinds[shard]}, row int, part int, {key} {kinds[key]}, offset int, used int, lost int"
    mine = df.where(F.col(length) > 0).select(shard, key, F.col(length).cast("int").alias(length), order) if order not in (shard, key, length) else df.where(F.col(length) > 0).select(shard, key, F.col(length).cast("int").alias(length))
    return mine.repartition(shard).sortWithinPartitions(shard, order).mapInPandas(run, schema)


def pack_crop(df: DataFrame, length_of_row: int, shard: str, key: str = "doc_id", length: str = "length", order: str = "doc_id", buffer: int = 1000) -> DataFrame:
    """Best fit with crop into rows of ``length_of_row`` + 1: (shard, row, part, key, offset, used, lost).

    The largest document of the buffer that fits; if none does the shortest one is cropped to fill the row and its rest
    is lost. The last row of a shard may stay short; ``full_rows`` leaves it out.
    """
    return _pack(df, length_of_row + 1, shard, key, length, order, buffer, True)


def pack_whole(df: DataFrame, length_of_row: int, shard: str, key: str = "doc_id", length: str = "length", order: str = "doc_id", buffer: int = 1000) -> DataFrame:
    """Best fit without crop; documents longer than a row are left out, a row ends when nothing fits."""
    return _pack(df.where(F.col(length) <= length_of_row), length_of_row, shard, key, length, order, buffer, False)


def full_rows(packed: DataFrame, capacity: int, shard: str) -> DataFrame:
    total = packed.groupBy(shard, "row").agg(F.sum("used").alias("__n")).where(F.col("__n") == capacity).drop("__n")
    return packed.join(total, [shard, "row"], "left_semi")


def rebase_offsets(df: DataFrame, row: list[str], order: str, max_pos: Column, stride: int) -> DataFrame:
    """Add rope_offset: each document of a row starts at the next multiple of ``stride`` after the one before it."""
    step = F.floor(max_pos / stride) + 1
    before = F.sum(step).over(Window.partitionBy(*row).orderBy(order)) - step
    return df.withColumn("rope_offset", (before * stride).cast("bigint"))


def shift_io(tokens: Column, length: int) -> tuple[Column, Column]:
    """Inputs and targets of a row of ``length`` + 1 tokens."""
    return F.slice(tokens, 1, length), F.slice(tokens, 2, length)


def drop_overflow(rows: DataFrame, row: str, max_pos: str, limit: int, batch: int) -> DataFrame:
    """Rows of the batches of ``batch`` rows in which no position reaches ``limit``."""
    numbered = rows.withColumn("batch", F.floor(F.col(row) / batch))
    bad = numbered.groupBy("batch").agg(F.max(max_pos).alias("__m")).where(F.col("__m") >= limit).select("batch")
    return numbered.join(bad, "batch", "left_anti")


def packing_stats(packed: DataFrame, docs: DataFrame, capacity: int, key: str, length: str, *groups: str) -> DataFrame:
    """(groups, rows, kept, cropped, padded, utilization, dropped documents)."""
    per = packed.groupBy(*groups, "row").agg(F.sum("used").alias("kept"), F.sum("lost").alias("cropped"))
    out = per.groupBy(*groups).agg(F.count("*").alias("rows"), F.sum("kept").alias("kept"), F.sum("cropped").alias("cropped"), F.sum(F.lit(capacity) - F.col("kept")).alias("padded"))
    gone = docs.join(packed.select(key).distinct(), key, "left_anti").groupBy(*groups).agg(F.count("*").alias("dropped"))
    out = out.withColumn("utilization", F.col("kept") / (F.col("rows") * capacity)).join(gone, list(groups), "left")
    return out.withColumn("dropped", F.coalesce("dropped", F.lit(0)))


def _fill(t: pa.Table, shard: str, capacity: int, fills: dict[str, int], rope: str | None, stride: int, count_on: bool) -> pa.RecordBatch:
    """Whole rows from their documents (shard, row, offset, arrays), ordered by row and offset."""
    group, row, offset = (t[c].combine_chunks() for c in (shard, "row", "offset"))
    at, place = row.to_numpy().astype(np.int64), offset.to_numpy().astype(np.int64)
    first = np.flatnonzero(place == 0)  # rows begin at 0
    of = np.cumsum(place == 0) - 1
    lists = {name: t[name].combine_chunks() for name in fills}
    size = next(iter(lists.values())).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    to = of[doc] * capacity + place[doc] + inner
    used = np.bincount(of, weights=size, minlength=len(first)).astype(np.int64)
    cols = [group.take(pa.array(first)), pa.array(at[first].astype(np.int32)), pa.array(np.bincount(of, minlength=len(first)).astype(np.int32)), pa.array(used.astype(np.int32))]
    for name, fill in fills.items():
        values = lists[name].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        full = np.full(len(first) * capacity, fill, np.int64)
        if name == rope:  # each document starts at the next multiple of the stride
            step = (np.maximum.reduceat(values, np.cumsum(size) - size) // stride + 1) * stride
            base = np.cumsum(step) - step
            values = values + (base - base[first][of])[doc]
            if count_on:
                ends = np.bincount(of, weights=step, minlength=len(first)).astype(np.int64)
                grid = np.arange(capacity)[None, :] - used[:, None] + ends[:, None]
                full = np.where(np.arange(capacity)[None, :] >= used[:, None], grid, 0).ravel()
        full[to] = values
        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * capacity), pa.array(full.astype(np.int32))))
    return pa.RecordBatch.from_arrays(cols, names=[shard, "row", "docs", "used", *fills])


def assemble_rows(packed: DataFrame, payload: DataFrame, capacity: int, shard: str, key: str, fills: dict[str, int], rope: str | None = "rope", stride: int = 256, count_on: bool = False) -> DataFrame:
    """(shard, row, docs, used, ``fills``...): rows of ``capacity`` from the places of ``pack_whole`` and the documents' arrays.

    ``payload`` has a row for each ``key`` with the array columns that ``fills`` names, all as long as the document; the
    rest of a row holds the column's fill. Positions in ``rope`` are re-based: a document starts at the next multiple of
    ``stride`` after the one before it, and with ``count_on`` the rest of the row counts on from there. Any column of
    labels goes along in the same way. Documents of a row meet in one partition in the order of their offsets; a task
    holds one row besides an Arrow batch. Nothing packed gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    placed = packed.select(shard, "row", "offset", key).join(payload.select(key, *fills), key).select(shard, "row", "offset", *fills)
    placed = placed.repartition(shard, "row").sortWithinPartitions(shard, "row", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = t if held is None else pa.concat_tables([held, t])
            begins = np.flatnonzero(t["offset"].to_numpy() == 0)
            last = int(begins[-1])  # the last row may go on in the next batch
            at = 0
            while at < last:  # some rows at once, or one
                stop = begins[max(int(np.searchsorted(begins, at + AT_ONCE, side="right")) - 1, int(np.searchsorted(begins, at)) + 1)]
                yield _fill(t.slice(at, stop - at), shard, capacity, fills, rope, stride, count_on)
                at = int(stop)
            held = t.slice(last)
        if held is not None:
            yield _fill(held, shard, capacity, fills, rope, stride, count_on)

    schema = f"{shard} {kinds[shard]}, row int, docs int, used int, " + ", ".join(f"{name} array<int>" for name in fills)
    return placed.mapInArrow(run, schema)
