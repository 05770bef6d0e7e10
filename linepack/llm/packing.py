"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces as long as a sequence fill one alone. The others are dealt at random into blocks of about ``BLOCK`` pieces, each
packed best fit by falling length. Where that takes the fewest bins that any packing can, only loosely filled bins are
touched again, elsewhere all bins that are not full; these, with some of the others to move pieces with, are pooled over
all blocks, dealt into blocks of about ``POOL`` pieces, and evolved: every block has several
islands, each with a population of packings that starts from best-fit packings of its own orders. A generation crosses
two packings by whole bins: the well-filled bins of one parent enter the other, bins that hold one of their pieces again
go, and the pieces displaced by that are put back best fit. After each epoch every island hands its best packing to the
next one. An island ends at the number of bins that no packing can beat, or when it has not improved for long. The best
packing over the islands counts; its loose bins are pooled again, until no more than one block of them is left. Blocks
and islands are rows, so Spark deals out the work.
"""

from __future__ import annotations

import random
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from ._common import drawn, materialise, partitions

BLOCK = 4096
POOL = 512
ISLANDS = 3
EPOCHS = 3
#: Generations of an epoch at most, and those without a better packing after which an island stops for the epoch.
GENERATIONS, STALE = 60, 20
POPULATION = 8
#: Pools after the first packing at most; each leaves about half an open bin a block, so few are needed.
ROUNDS = 3
#: Pieces of a bin up to which two of them are swapped at once.
FEW = 4
_LAST = 1 << 60
#: A bin is loosely filled if this share of it or more is free.
LOOSE = 1 / 16

Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins | None = None, rooms: list[int] | None = None) -> Bins:
    """Put ``items`` in turn into the open bin that they leave least room in, or into a new one.

    Open bins are kept by the room they have, and a bit for each room with a bin finds the least one that fits. ``rooms``,
    the room in each of ``bins``, is kept up to date if given.
    """
    bins = bins if bins is not None else []
    rooms = rooms if rooms is not None else [capacity - sum(map(sizes.__getitem__, b)) for b in bins]
    by_room: dict[int, list[int]] = {}
    some = 0
    for k, room in enumerate(rooms):
        if room:
            by_room.setdefault(room, []).append(k)
            some |= 1 << room
    for i in items:
        size = sizes[i]
        if fit := some >> size:
            room = size + (fit & -fit).bit_length() - 1
            held = by_room[room]
            k = held.pop()
            if not held:
                some ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
            rooms.append(capacity)
        rooms[k] = left = room - size
        if left:
            by_room.setdefault(left, []).append(k)
            some |= 1 << left
    return bins


def fitness(bins: Bins, sizes: list[int], capacity: int, rooms: list[int] | None = None) -> tuple[int, float]:
    """Fewer bins first, then bins that are full or empty rather than half full; larger is better."""
    if rooms is None:
        rooms = [capacity - sum(map(sizes.__getitem__, b)) for b in bins]
    return -len(bins), sum([((capacity - r) / capacity) ** 2 for r in rooms])


def refill(bins: Bins, loose: list[int], sizes: list[int], capacity: int, rooms: list[int] | None = None) -> None:
    """Swap one or two pieces of a bin, or none, for one or two larger ``loose`` ones that fill it better, best swap first.

    Both lists are changed, and ``rooms`` of the bins if given; pieces that leave a bin are loose, so these become smaller and easier to place. Loose pieces are
    held by size: one is found by bisection, two by a walk from both ends.
    """
    held = sorted((sizes[i], i) for i in loose)
    rooms = rooms if rooms is not None else [capacity - sum(map(sizes.__getitem__, b)) for b in bins]
    for at, room in enumerate(rooms):
        if not room or not held:
            continue
        b = bins[at]
        gain, out, into = 0, (), ()
        for old in chain([()], combinations(b, 1), combinations(b, 2) if len(b) <= FEW else ()):
            gone = sum(map(sizes.__getitem__, old))
            most = gone + room
            k = bisect_right(held, (most, _LAST)) - 1
            if k >= 0 and held[k][0] - gone > gain:
                gain, out, into = held[k][0] - gone, old, (k,)
            low, high = 0, min(k, len(held) - 1)
            while low < high and gain < room:
                both = held[low][0] + held[high][0]
                if both > most:
                    high -= 1
                else:
                    if both - gone > gain:
                        gain, out, into = both - gone, old, (low, high)
                    low += 1
            if gain == room:
                break
        if gain:
            new = [held[k][1] for k in into]
            for k in reversed(into):
                del held[k]
            for i in out:
                insort(held, (sizes[i], i))
            b[:] = [i for i in b if i not in out] + new
            rooms[at] -= gain
    loose[:] = [i for _, i in held]


def cross(a: Bins, b: Bins, sizes: list[int], capacity: int, rnd: random.Random) -> tuple[Bins, list[int]]:
    """Whole well-filled bins of ``b`` enter ``a``: the child and the room in each of its bins."""
    get = sizes.__getitem__
    fill = sorted((sum(map(get, x)), k) for k, x in enumerate(b))
    full = [k for f, k in fill if f == capacity] or [k for _, k in fill[-max(1, len(fill) // 4) :]]
    chosen = [k for k in full if rnd.random() < 0.7] or [full[-1]]
    taken = [list(b[k]) for k in chosen]
    inside = {i for x in taken for i in x}
    kept, loose = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append((capacity - sum(map(get, x)), list(x)))
        else:
            loose += [i for i in x if i not in inside]
    # the worst bins are opened too, so that a child can do better than both
    kept.sort(key=lambda x: -x[0])
    worst = min(len(kept), 2 + len(kept) // 50)
    loose += [i for _, x in kept[:worst] for i in x]
    bins, rooms = [x for _, x in kept[worst:]], [r for r, _ in kept[worst:]]
    refill(bins, loose, sizes, capacity, rooms)
    loose.sort(key=get, reverse=True)
    rooms = [capacity - sum(map(get, x)) for x in taken] + rooms
    return best_fit(loose, sizes, capacity, taken + bins, rooms), rooms


def _as_bins(assigned: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, k in enumerate(assigned):
        bins[k].append(i)
    return bins


def _as_list(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def fewest(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing can go below: by the total, and as pieces over half a bin need one each."""
    return max(-(-sum(sizes) // capacity), sum([2 * x > capacity for x in sizes]))


def best_fit_decreasing(sizes: list[int], capacity: int) -> Bins:
    return best_fit(sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), sizes, capacity)


def evolve(sizes: list[int], capacity: int, population: list[Bins], seed: int, generations: int = GENERATIONS, stale: int = STALE) -> list[Bins]:
    """One epoch of one island; the population, best packing first. It stops early at the fewest bins possible."""
    rnd, least = random.Random(seed), fewest(sizes, capacity)
    population = list(population) or [best_fit_decreasing(sizes, capacity)]
    while len(population) < POPULATION and min(map(len, population)) > least:
        order = sorted(range(len(sizes)), key=lambda i: sizes[i] * (1 + 0.3 * rnd.random()), reverse=True)
        population.append(best_fit(order, sizes, capacity))
    rated = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2], reverse=True)
    born, since = len(rated), 0
    for _ in range(generations):
        if len(rated[0][2]) <= least or since >= stale or len(rated) < 2:
            break
        top = rated[0][0]
        i, j = (min(rnd.sample(range(len(rated)), 2)) for _ in range(2))
        i, j = (i, j) if i != j else (i, (i + 1) % len(rated))
        for a, b in ((i, j), (j, i)):
            child, rooms = cross(rated[a][2], rated[b][2], sizes, capacity, rnd)
            fit = fitness(child, sizes, capacity, rooms)
            if all(fit != x[0] for x in rated):  # another like it is there
                born += 1
                rated.append((fit, born, child))
        rated = sorted(rated, key=lambda x: x[:2], reverse=True)[:POPULATION]
        since = 0 if rated[0][0] > top else since + 1
    return [p for _, _, p in rated]


def _epoch(capacity: int, epoch: int):
    """Rows (block, island, sizes, population, migrant) in, the island's population after an epoch out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept, count, square, done = [], [], [], []
            for row in frame.itertuples():
                sizes = row.sizes.tolist()
                held = [] if row.population is None else [_as_bins(x.tolist()) for x in row.population]
                held += [] if row.migrant is None else [_as_bins(row.migrant.tolist())]
                if epoch == 0 and row.island:  # the first island starts with best fit by falling length, the others with orders of their own
                    rnd = random.Random(row.block * ISLANDS + row.island)
                    held = [best_fit(sorted(range(len(sizes)), key=lambda i: sizes[i] * (1 + 0.15 * rnd.random()), reverse=True), sizes, capacity)]  # noqa: B023
                found = evolve(sizes, capacity, held, 1_000_003 * epoch + int(row.block) * ISLANDS + int(row.island))
                kept.append([_as_list(x, len(sizes)) for x in found])
                rating = fitness(found[0], sizes, capacity)
                count.append(-rating[0])
                square.append(rating[1])
                done.append(len(found[0]) <= fewest(sizes, capacity))
            yield pd.DataFrame({"block": frame["block"], "island": frame["island"], "sizes": frame["sizes"], "population": kept, "best": [x[0] for x in kept], "bins": count, "square": square, "done": done})

    return run


def _dealt(items: DataFrame, per_block: int, salt: int) -> DataFrame:
    """(block, items, sizes): ``items`` (item, length, part) dealt at random into blocks of about ``per_block`` pieces.

    Pieces of one ``part`` (a bin so far) stay together.
    """
    blocks = max(1, -(-items.count() // per_block))
    x = F.sort_array(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length"))))
    grouped = items.groupBy(F.expr(f"pmod(xxhash64(part, {salt}), {blocks})").alias("block")).agg(x.alias("x"))
    return materialise(grouped.select("block", F.col("x.item").alias("items"), F.col("x.length").alias("sizes")), "blocks")


def _placed(grouped: DataFrame, best: DataFrame) -> DataFrame:
    """(item, length, bin, again) of ``grouped`` (block, items, sizes) by ``best`` (block, best, again)."""
    rows = grouped.join(best, "block").select("block", "again", F.explode(F.arrays_zip("items", "sizes", "best")).alias("x"))
    part = (F.col("block") * (1 << 24) + F.col("x.best")).alias("part")
    return rows.select(F.col("x.items").alias("item"), F.col("x.sizes").cast("long").alias("length"), part, F.get("again", F.col("x.best")).alias("again"))


def _loose(sizes: list[int], assigned: list[int], capacity: int) -> list[bool]:
    """Whether each bin is to be packed again."""
    room = [capacity] * (max(assigned, default=-1) + 1)
    for size, k in zip(sizes, assigned, strict=True):
        room[k] -= size
    free = 1 if len(room) > fewest(sizes, capacity) else max(1, LOOSE * capacity)
    return [x >= free for x in room]


def _first(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [_as_list(best_fit_decreasing(x.tolist(), capacity), len(x)) for x in frame["sizes"]]
            yield pd.DataFrame({"block": frame["block"], "best": best, "again": [_loose(x.tolist(), b, capacity) for x, b in zip(frame["sizes"], best, strict=True)]})

    return run


def _evolved(grouped: DataFrame, capacity: int) -> DataFrame:
    """(block, best, again): the best packing of each block over its islands and their epochs."""
    spark = grouped.sparkSession
    schema = "block bigint, island int, sizes array<int>, population array<array<int>>, best array<int>, bins int, square double, done boolean"
    none = F.lit(None)
    state = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", none.cast("array<array<int>>").alias("population"), none.cast("array<int>").alias("migrant"))
    state = materialise(state.repartition(partitions(spark), "block", "island").mapInPandas(_epoch(capacity, 0), schema), "epoch")
    over = state
    for epoch in range(1, EPOCHS):
        ended = over.groupBy("block").agg(F.bool_or("done").alias("ended"))
        over = over.join(ended.where("not ended").select("block"), "block")
        guests = over.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("migrant"))
        met = over.select("block", "island", "sizes", "population").join(guests, ["block", "island"]).repartition(partitions(spark), "block", "island")
        over = materialise(met.mapInPandas(_epoch(capacity, epoch), schema), "epoch")
        if over.isEmpty():
            break
        state = state.unionByName(over)
    won = state.groupBy("block").agg(F.max_by(F.struct("sizes", "best"), F.struct(-F.col("bins"), "square", "island")).alias("x"))

    def loose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            again = [_loose(x.tolist(), b.tolist(), capacity) for x, b in zip(frame["sizes"], frame["best"], strict=True)]
            yield pd.DataFrame({"block": frame["block"], "best": frame["best"], "again": again})

    return won.select("block", "x.sizes", "x.best").mapInPandas(loose, "block bigint, best array<int>, again array<boolean>")


def pack(items: DataFrame, capacity: int, block: int = BLOCK, pool: int = POOL) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` (item: distinct long, length: 1 to ``capacity``), in few sequences.

    Offsets in a sequence are gapless from 0; sequence numbers are unique but have gaps. An empty table gives no row.
    """
    whole = items.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("item", "length", F.col("item").alias("part"))
    grouped = _dealt(rest, block, 0)
    best = grouped.select("block", "sizes").repartition(partitions(items.sparkSession), "block").mapInPandas(_first(capacity), "block bigint, best array<int>, again array<boolean>")
    kept, last = [], None
    for turn in range(ROUNDS + 1):
        placed = materialise(_placed(grouped, best), "placed")
        bins = placed.groupBy("part").agg(F.bool_or("again").alias("again"))
        open_, full = (r or 0 for r in bins.agg(F.count_if("again"), F.count_if(~F.col("again"))).first())
        number = (F.col("part") * (ROUNDS + 1) + turn).alias("sequence_id")
        if turn == ROUNDS or open_ < 2 or last == 1:
            kept.append(placed.select("item", "length", number))
            break
        again = F.col("again") | drawn("part", 31 + turn, F.lit(min(1.0, 2 * open_ / max(1, full))))  # two others for each
        kept.append(placed.where(~again).select("item", "length", number))
        grouped = _dealt(placed.where(again).select("item", "length", "part"), pool, turn + 1)
        last = grouped.count()
        best = _evolved(grouped, capacity)
    rows = reduce(DataFrame.unionByName, kept)
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item"))
    return rows.select("item", "sequence_id", (before - F.col("length")).alias("offset")).unionByName(whole)


def pack_documents(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most ``capacity`` ids.

    A document is its ids and one ``end_id``; only longer ones are cut. A null or empty text is the one id ``end_id``.
    Rows are packed as they are: ids may be null or repeat, and other columns are not carried. An empty table gives an
    empty result. The pieces' ids are counted once and written down, so a repeated task cannot change them.
    """
    found = bpe.pieces(docs.select("doc_id", "text"), vocab, capacity, end_id)
    found = materialise(found.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(found.select("item", "length"), capacity)
    return found.join(placed, "item").drop("item")
