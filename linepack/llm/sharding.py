"""Sharding by a minimax contiguous partition, in DataFrame functions only.

Rows with equal texts are an atomic group; groups are ordered by the 64-bit hash of their text. The smallest capacity
for which a greedy pass over the ordered groups needs no more than ``shards`` shards is found by binary search.

The search never needs all groups at once. Neighbouring groups are summed in cells (ranges of hashes, at most a few
thousand in all, whatever the input), and a greedy pass over cells gives lower and upper bounds of the capacity and of
every cut. Only the cells that a cut can lie in are summed again in finer cells, until each of them is one group; the
bounds then meet, and the cuts are exact.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, partitions

#: Cells of a refinement step: 2 ** FAN of each cell that is opened.
FAN = 6
#: Hash bits of the first cells.
FIRST = 12
#: Most parts in which a shard's slots are numbered; shards * PARTS counts are broadcast.
PARTS = 4096


def _position(column: Column) -> Column:
    """The order of a group: the hash of its text, from 0 to 2 ** 62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(column), 2)


Cell = tuple[int, int, int]  # first position, bits of its width (0: one group), sum of its sizes


def greedy(prefix: list[int], shards: int, capacity: int) -> list[int] | None:
    """Indices after which to cut so that each shard's sum is at most ``capacity``; None if that needs more shards."""
    cuts, at = [], 0
    for _ in range(shards):
        nxt = bisect_right(prefix, prefix[at] + capacity) - 1
        if nxt == at:
            return None
        cuts.append(at := nxt)
        if at == len(prefix) - 1:
            return cuts
    return None


def least_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for these atomic sizes in this order, and its cuts."""
    prefix = [0, *accumulate(sizes)]
    low, high = max([-(-prefix[-1] // shards), *sizes]), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(prefix, shards, mid) else (mid + 1, high)
    return low, greedy(prefix, shards, low) or []


def _reach(prefix: list[int], shards: int, capacity: int, split: bool) -> list[int]:
    """Cells in which the greedy pass's cuts lie at the latest (``split``: if a cell could be split anywhere) or at the earliest."""
    out, at = [], 0
    for _ in range(shards):
        if split:
            at = min(prefix[-1], at + capacity)
            out.append(bisect_right(prefix, at) - 1)
        else:
            k = bisect_right(prefix, at + capacity) - 1
            at = prefix[k]
            out.append(k)
    return out


def cut_positions(groups: DataFrame, shards: int, fan: int = FAN, first: int = FIRST) -> list[int]:
    """The first hash positions of shards 1, 2, ... for ``groups`` (position, size), one row a position.

    What reaches the driver is the sums of cells: 2 ** first, then for each round those near the cuts.
    """
    def summed(df: DataFrame, bits: Column) -> list[Cell]:
        df = df.withColumn("bits", bits).where("bits is not null")
        rows = df.groupBy("bits", F.expr("shiftright(position, bits)").alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("position").alias("at")).collect()
        return [(r["at"], 0, r["size"]) if r["n"] == 1 else (r["cell"] << r["bits"], r["bits"], r["size"]) for r in rows]

    cells = sorted(summed(groups, F.lit(62 - first)))
    while cells:
        sizes = [c[2] for c in cells]
        prefix = [0, *accumulate(sizes)]
        # cells that stay whole can only need more: an upper bound; cells that may be split anywhere, a lower one
        upper, _ = least_capacity(sizes, shards)
        single = max([s for (_, b, s) in cells if b == 0], default=0)
        lower = max(-(-prefix[-1] // shards), single)
        windows = [(k, k) for k, c in enumerate(cells) if c[1] > 0 and c[2] > lower]  # fewer than ``shards``
        if not windows:  # no cell is larger than the capacity can be, so a greedy pass over whole cells never stands still
            # a cut lies between where the smallest capacity reaches with whole cells and the largest with split ones
            early, late = _reach(prefix, shards, lower, False), _reach(prefix, shards, upper, True)
            windows = [(a, min(b, len(cells) - 1)) for a, b in zip(early, late, strict=True) if any(c[1] for c in cells[a : b + 1])]
        if not windows:
            break
        bits, merged = F.lit(None).cast("int"), _merged(windows)
        for first_, last in merged:
            widths = [c[1] for c in cells[first_ : last + 1] if c[1]]
            step = min(min(widths), max(0, max(widths) - fan))
            bits = F.when(F.col("position").between(cells[first_][0], cells[last][0] + (1 << cells[last][1]) - 1), step).otherwise(bits)
        gone = {k for a, b in merged for k in range(a, b + 1)}
        cells = sorted([c for k, c in enumerate(cells) if k not in gone] + summed(groups, bits))
    if not cells:
        return []
    _, cuts = least_capacity([c[2] for c in cells], shards)
    return [cells[k][0] for k in cuts if k < len(cells)]


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed ranges of cells, overlapping and neighbouring ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law ``bytes``, shards of nearly equal size.

    A row's size is its text's UTF-8 bytes (null: none) plus ``overhead``. Rows with equal texts share a shard, nulls
    and empty texts among them. The largest shard
    is as small as contiguous shards of the hash order allow. Slots of a shard are gapless from 0, in no special order:
    they are numbered in many parts, whose counts place them, so no shard is gathered in one task. With fewer groups
    than shards some shards are empty. Ids may be null or repeat; other columns are not carried.
    """
    text = F.coalesce("text", F.lit(""))
    parts = min(PARTS, 4 * partitions(docs.sparkSession))
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _position(text).alias("position"))
    rows = materialise(rows.withColumn("part", F.expr(f"pmod(xxhash64(monotonically_increasing_id()), {parts})").cast("int")), "rows")
    groups = materialise(rows.groupBy("position").agg(F.sum("size").alias("size")), "groups")
    cuts = cut_positions(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("position") >= c).cast("int")
    rows = rows.withColumn("shard", shard)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "position")
    placed = rows.withColumn("at", F.row_number().over(own)).join(F.broadcast(base), ["shard", "part"])  # at most shards * PARTS rows
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
