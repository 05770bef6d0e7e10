"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r every bit position gets a nonzero vector of r + 1 bits, and each nonzero
vector v of r + 1 bits gives a mask: the positions whose vector has an odd product with v. The vectors of at most r
differing positions span at most r dimensions, so some v is orthogonal to all of them and its mask leaves all of them
out: the pair has equal masked bits in that table. So 2^(r+1) - 1 tables lose no pair within the radius.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, partitions
from .graph import components

BITS = 64
#: Rows of a bucket that one task compares at once; larger buckets are dealt out in blocks of this size.
BUCKET = 4096


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words; white space is the ASCII one."""
    return text.lower().split()


def shingles(found: list[bytes], width: int) -> list[bytes]:
    """All runs of ``width`` words, repeats included; fewer words give the whole sequence, none gives nothing."""
    if len(found) <= width:
        return [b" ".join(found)] if found else []
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(found) - width] + 1)).tolist()
    return [line[s:e] for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint(features: list[bytes], seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the features' XXH64; zero for no features."""
    if not features:
        return 0
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(features), 1 << 15):
        part = features[at : at + (1 << 15)]
        h = np.fromiter((digest(x, seed) for x in part), np.uint64, len(part))
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(features)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(``id_col``, fp): the 64-bit fingerprint of each whole text's shingles as a signed long.

    A null text counts as empty; an empty text has fingerprint 0. Ids are carried as they are, null or repeated.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(shingles(words(text or b""), width))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


@cache
def _mixers(n: int) -> np.ndarray:
    rnd = random.Random(7)
    return np.array([[rnd.getrandbits(64) | 1] for _ in range(n)], np.uint64)


def set_fingerprints(digests: np.ndarray, n: int, bits: int) -> np.ndarray:
    """``n`` independent fingerprints of ``bits`` bits (up to 64) of a set of 64-bit digests (not empty), as signed longs.

    The digests are mixed anew for each fingerprint; a bit is 1 if it is set in over half of them.
    """
    total = np.zeros(n * BITS, np.float32)
    for at in range(0, len(digests), 2048):
        h = digests[at : at + 2048] * _mixers(n)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        each = np.unpackbits(np.ascontiguousarray(h.T).view(np.uint8), axis=1)
        total += np.ones(len(each), np.float32) @ each.astype(np.float32)
    return (np.packbits(2 * total > len(digests)).view(np.uint64) & np.uint64((1 << bits) - 1)).view(np.int64)


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 bit masks of the cover; the vectors are spread evenly over the positions."""
    vectors = [1 + i % ((2 << radius) - 1) for i in range(bits)]
    random.Random(64).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 << radius)]


def _tree(ids: np.ndarray, fps: np.ndarray, most: int, far: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket: breadth-first over those not yet reached, so at most one link a row.

    ``fps`` has the words of a row's bits; rows are linked if they differ in at most ``most`` of all of them. ``far``:
    only pairs with a far row are looked at.
    """
    out, rest, todo = [], np.arange(len(ids)), []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        i = todo.pop()
        hit = np.bitwise_count(fps[rest] ^ fps[i]).sum(1, dtype=np.int64) <= most
        if far is not None:
            hit &= far[rest] | far[i]
        if hit.any():
            found = rest[hit]
            out += [(int(ids[i]), int(j)) for j in ids[found]]
            todo += found.tolist()
            rest = rest[~hit]
    return out


def _words(column: pa.Array) -> np.ndarray:
    """Rows of the words of an array column whose rows are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def _bucket_links(most: int, bucket: int, bits: list[int]):
    """Rows (mask, node, fp) sorted by bucket in; links out, and the rows of buckets that are too large for one task, marked.

    ``bits`` are the masks by number modulo their count; a row's key is the masked first word of ``fp``.
    """
    names = ["a", "b", "mask", "key", "fp"]
    kind = pa.list_(pa.int64())
    cover = np.array(bits, np.uint64)

    def done(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b, pa.nulls(len(links), pa.int32()), pa.nulls(len(links), pa.int64()), pa.nulls(len(links), kind)], names=names)

    def large(mask: np.ndarray, key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * fp.shape[1]), pa.array(fp.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(mask, pa.int32()), pa.array(key.view(np.int64)), lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marked = None, None  # the rows of the last bucket so far; the (mask, key) found to be large
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            fp = _words(batch.column(2))
            cols = [mask, fp[:, 0] & cover[mask % len(cover)], node, fp]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            held = None
            mask, key, node, fp = cols
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(mask)]))
            if marked == (mask[0], key[0]):
                yield large(*(x[: ends[0]] for x in cols))
                starts, ends = starts[1:], ends[1:]
                if not len(starts):
                    continue
            last = slice(starts[-1], ends[-1])
            if ends[-1] - starts[-1] > bucket:
                marked = (mask[last.start], key[last.start])
                yield large(*(x[last] for x in cols))
            else:
                held = [x[last] for x in cols]
            starts, ends, links = starts[:-1], ends[:-1], []
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1, dtype=np.int64) <= most]
            links += list(zip(node[two].tolist(), node[two + 1].tolist(), strict=True))
            for k in np.flatnonzero(ends - starts > 2):
                s, e = starts[k], ends[k]
                if e - s > bucket:
                    yield large(mask[s:e], key[s:e], node[s:e], fp[s:e])
                else:
                    links += _tree(node[s:e], fp[s:e], most)
            if links:
                yield done(links)
        if held is not None and (links := _tree(held[2], held[3], most)):
            yield done(links)

    return run


def _block_links(most: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        links = _tree(t["node"].to_numpy(), _words(t["fp"].combine_chunks()), most, t["far"].to_numpy(zero_copy_only=False))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def _dealt(hot: DataFrame, bucket: int, *carried: str) -> DataFrame:
    """(mask, key, i, j, far, node, ...): far rows meet all rows of their bucket (of ``n`` rows), block i against block j."""
    rest = ["far", "node", *carried]
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    dealt = hot.withColumn("blocks", blocks).withColumn("own", F.expr("pmod(xxhash64(node, 7), blocks)").cast("int"))
    busy = dealt.where("far").select("mask", "key", F.col("own").alias("with")).distinct()
    ours = dealt.join(busy, ["mask", "key"]).where("not far or own <> with")
    pairs = ours.select("mask", "key", F.when(F.col("far"), F.least("own", "with")).otherwise(F.col("with")).alias("i"),
                        F.when(F.col("far"), F.greatest("own", "with")).otherwise(F.col("own")).alias("j"), *rest)
    alone = dealt.where("far").select("mask", "key", F.col("own").alias("i"), F.col("own").alias("j"), *rest)
    far = dealt.where("far").join(dealt.where("not far").select("mask", "key", F.col("own").alias("j")).distinct(), ["mask", "key"])
    far = far.where("own <> j").select("mask", "key", F.col("own").alias("i"), "j", *rest)
    return pairs.unionByName(alone).unionByName(far).distinct()


def links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET, bits: int = BITS, most: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``nodes`` that share a bucket and stand.

    ``fps`` is an array of fingerprints of ``bits`` bits; two nodes share a bucket wherever one of them has equal bits under
    a mask of the cover, so in any case where they differ in at most ``radius`` bits of one. ``check`` (an array of more
    words, where there is such a column) goes with a row into its buckets: a pair stands if it differs in at most ``most``
    bits (``radius`` if not given) of that fingerprint and all check words together. The test is the last one: no link is
    dropped later, so a row that is left aside, because it hangs on another already, hangs on it by a link that stands.

    Every bucket gives a spanning forest of its pairs, not all of them. A bucket of over ``bucket`` rows is dealt out: rows
    near its most common pivot are joined to that; the others meet all rows of the bucket, block against block, in a task
    of their own for each pair of blocks, so that no pair is lost and no task holds more than two blocks. Node ids must be
    distinct and not null.
    """
    spark = nodes.sparkSession
    most = radius if most is None else most
    tables = masks(radius, bits)
    check = [F.col("check")] if "check" in nodes.columns else []
    each = nodes.select("node", *check, F.posexplode("fps").alias("which", "own"))
    rows = each.select("node", F.concat(F.array("own"), *check).alias("fp"), F.explode(F.sequence(F.col("which") * len(tables), F.col("which") * len(tables) + len(tables) - 1)).alias("mask"))
    masked = F.element_at(F.array(*[F.lit(_signed(m)) for m in tables]), F.pmod("mask", F.lit(len(tables))) + 1).bitwiseAND(F.get("fp", F.lit(0)))
    rows = rows.select("mask", "node", "fp").repartition(partitions(spark), "mask", masked)  # the key itself need not be shuffled
    rows = rows.sortWithinPartitions("mask", masked, "node")  # buckets with common rows tend to one hub
    found = materialise(rows.mapInArrow(_bucket_links(most, bucket, tables), "a bigint, b bigint, mask int, key bigint, fp array<bigint>"), "buckets")
    out = found.where("mask is null").select("a", "b")
    hot = found.where("mask is not null").select("mask", "key", F.col("a").alias("node"), "fp")
    if hot.isEmpty():
        return out.distinct()
    sizes = hot.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp"), "fp", "node")).alias("p"))
    hot = hot.join(sizes.select("mask", "key", "n", F.col("p.fp").alias("pivot"), F.col("p.node").alias("at")), ["mask", "key"])
    apart = F.aggregate(F.zip_with("fp", "pivot", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    hot = materialise(hot.withColumn("far", apart > most), "large")
    near = hot.where("not far and node <> at").select(F.col("at").alias("a"), F.col("node").alias("b"))
    met = _dealt(hot, bucket, "fp").groupBy("mask", "key", "i", "j").applyInArrow(_block_links(most), "a bigint, b bigint")
    return out.unionByName(near).unionByName(met).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(``id_col``, fingerprint, component_id) for each row: fingerprints link at ``radius`` or fewer differing bits.

    ``component_id`` is the smallest id reachable over links, itself included. Null and empty texts have fingerprint
    zero and link like any other. Equal texts have equal fingerprints, so copies are one node however many there are.
    Repeated rows stay repeated; rows with a null id keep it and take their component's smallest id, null if it has
    none. Other columns are not carried, so their names cannot clash. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fps = materialise(fingerprints(own, width=width), "fingerprints")
    nodes = materialise(fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select("node", F.array("node").alias("fps")), radius))
    roots = nodes.join(joined, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(roots.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "named")
    return fps.join(named, "fp").select(F.col("doc_id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def set_digests(found: list[bytes], width: int) -> np.ndarray:
    """The distinct 64-bit digests of the shingles of ``width`` words, in order."""
    of = shingles(found, width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in of), np.uint64, len(of)))


def set_hashes(found: list[bytes], width: int) -> np.ndarray:
    """The distinct 32-bit hashes of the shingles of ``width`` words, in order."""
    return np.unique(set_digests(found, width).astype(np.uint32))


def _set_hashes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [set_hashes(words(text or b""), width).tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def _likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def alike_tree(nodes: list[int], sets: list[bytes], least: float, far: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs of one bucket whose sets have a Jaccard similarity of ``least`` or more.

    Breadth-first like ``_tree``, but a row is reached by a link that holds only. ``far``: only pairs with a far row are
    looked at. Sets are not empty.
    """
    if len(nodes) < 3:
        return [(nodes[0], nodes[1])] if len(nodes) == 2 and (far is None or far.any()) and _likeness(*sets) >= least else []
    sizes = np.fromiter((len(x) // 4 for x in sets), np.int64, len(sets))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    names, flat = np.unique(np.frombuffer(b"".join(sets), np.uint32), return_inverse=True)
    out, rest, todo = [], np.arange(len(nodes)), []
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        i = todo.pop()
        of = flat[starts[i] : starts[i] + sizes[i]]
        mark = np.zeros(len(names), np.int8)
        mark[of] = 1
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)[rest]
        hit = both / (sizes[rest] + sizes[i] - both) >= least
        if far is not None:
            hit &= far[rest] | far[i]
        if hit.any():
            found = rest[hit]
            out += [(nodes[i], nodes[j]) for j in found.tolist()]
            todo += found.tolist()
            rest = rest[~hit]
    return out


def _pairs(links: list[tuple[int, int]]) -> dict[str, pa.Array]:
    return {name: pa.array([x[k] for x in links], pa.int64()) for k, name in enumerate(("a", "b"))}


def _bucket_alike(least: float):
    """Rows (key, node, set) sorted by key in, links out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, node, of in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != at:
                    found += alike_tree(nodes, sets, least)
                    at, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(of)
            yield pa.RecordBatch.from_pydict(_pairs(found))
        yield pa.RecordBatch.from_pydict(_pairs(alike_tree(nodes, sets, least)))

    return run


def _block_alike(least: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table(_pairs(alike_tree(t["node"].to_pylist(), t["set"].to_pylist(), least, t["far"].to_numpy(zero_copy_only=False))))

    return run


def _near_pivot(least: float):
    """Whether a row's set is like its pivot's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [_likeness(x, y) < least for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(far, pa.bool_())], names=["key", "node", "n", "at", "far"])

    return run


def alike_links(rows: DataFrame, sets: DataFrame, least: float, bucket: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of all pairs with a Jaccard similarity of ``least`` that share a bucket.

    ``rows`` (key, node, n): the nodes of each bucket and their number, or what counts as such for long sets; ``sets``
    (node, set). Every bucket gives a spanning forest of the pairs that hold. A bucket of over ``bucket`` rows is dealt out
    as in ``links``: rows that are like a pivot are joined to that, the others meet all rows of the bucket, block against
    block.
    """
    cold = rows.where(F.col("n") <= bucket).select("key", "node").join(sets, "node").select("key", "node", "set")
    cold = cold.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    out = cold.mapInArrow(_bucket_alike(least), "a bigint, b bigint")
    hot = rows.where(F.col("n") > bucket)
    if hot.isEmpty():
        return out.distinct()
    part = F.expr(f"pmod(xxhash64(node, 9), cast(ceil(n / {bucket}) as bigint))").alias("part")
    pivots = hot.groupBy("key", "n").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("at")).join(sets.withColumnRenamed("node", "at"), "at")
    pivots = pivots.select("key", F.explode(F.expr(f"sequence(0L, cast(ceil(n / {bucket}) as bigint) - 1)")).alias("part"), "at", F.col("set").alias("y"))
    met = hot.select("key", "node", "n", part).join(sets, "node").join(pivots, ["key", "part"]).select("key", "node", "n", "at", "set", "y")
    hot = materialise(met.mapInArrow(_near_pivot(least), "key bigint, node bigint, n bigint, at bigint, far boolean"), "large")
    near = hot.where("not far and node <> at").select(F.col("at").alias("a"), F.col("node").alias("b"))
    dealt = _dealt(hot.withColumn("mask", F.lit(0)), bucket).join(sets, "node").select("key", "i", "j", "node", "far", "set")
    met = dealt.groupBy("key", "i", "j").applyInArrow(_block_alike(least), "a bigint, b bigint")
    return out.unionByName(near).unionByName(met).distinct()


#: Sets of Jaccard similarity 0.8 differ in 0.15 of the bits of their fingerprints, unlike ones in 0.5. The masks cover RADIUS
#: bits. CHECKS words of other fingerprints go with every row; a link stands up to a share APART of all bits compared.
DIFFER, RADIUS, CHECKS, APART = 0.15, 3, 3, 0.22
#: Rows that share a key by chance, about, and the share of pairs of similarity 0.8 that may share no bucket.
CROWD, MISSED = 128, 0.002
#: Bytes of a set that count as one row of a candidate group.
ROW = 1 << 16


def offered(bits: int, radius: int = RADIUS, differ: float = DIFFER) -> float:
    """How likely a pair shares a bucket of one fingerprint whose bits differ with probability ``differ``.

    Each position has one of 2^(radius + 1) - 1 vectors. A table leaves all differing positions out if their vectors do not
    span the whole space. Vectors count as drawn one by one; ``masks`` spreads them evenly, so they span it somewhat sooner
    (0.44 measured in place of 0.48 for 32 bits).
    """
    full, n = radius + 1, (2 << radius) - 1
    rank = [1.0] + [0.0] * full  # of the vectors of the positions so far
    share, out = (1 - differ) ** bits, 0.0
    for d in range(bits + 1):
        out += share * (1 - rank[full])
        share *= (bits - d) / (d + 1) * differ / (1 - differ)
        rank = [rank[r] * ((1 << r) - 1) / n + (rank[r - 1] * (n + 1 - (1 << r - 1)) / n if r else 0.0) for r in range(full + 1)]
    return out


def shape(rows: int) -> tuple[int, int]:
    """(number of fingerprints, bits of each) for a search among ``rows``.

    Keys have 8 of 15 bits of a fingerprint and grow with the logarithm of the rows, so the rows that meet by chance stay
    about ``CROWD`` a bucket; longer keys part more pairs, so the fingerprints grow in number, with about the 0.23rd power
    of the rows.
    """
    bits = min(64, max(32, math.ceil((math.log2(max(rows, 1)) - math.log2(CROWD)) * 15 / 8)))
    return math.ceil(math.log(MISSED) / math.log(1 - offered(bits))), bits


def _signatures(width: int, n: int):
    """(doc_id, digest of the set of shingles, ``n`` fingerprints) of (doc_id, text); a text without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps = [], []
            for text in batch.column(1).to_pylist():
                of = set_digests(words(text or b""), width)
                digests.append(hashlib.sha256(of.tobytes()).digest())
                fps.append(set_fingerprints(of, n, BITS) if len(of) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "digest", "fps"])

    return run


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, bucket: int = 1024) -> DataFrame:
    """One document of each group of copies and near copies stays (the smallest doc_id); all columns are kept.

    Two documents are linked if the sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more
    (sets of 32-bit shingle hashes) and both are in one candidate group. Candidate groups are the components of a
    covering search over fingerprints of these sets, as many and as long as ``shape`` gives for the number of rows: every
    pair within ``RADIUS`` bits in one of them shares a bucket, and so do many pairs beyond. A candidate group is searched
    as a whole with the Jaccard test itself, so no hub that fails it hides a pair. The result's groups are the components
    of the links. Equal sets are one node. Null texts count as empty, and empty texts are copies of each other. Texts are
    joined by merge joins at every size, so the plan does not change with it. Rows with a null doc_id always stay. Of rows
    that repeat a doc_id and text all stay; a doc_id that repeats with other texts is one node, for which the links of each
    text count. An empty table gives an empty result.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).where("doc_id is not null")
    n, bits = shape(docs.count())
    marks = own.mapInArrow(_signatures(width, n + CHECKS), "doc_id bigint, digest binary, fps array<bigint>")
    copies = materialise(materialise(marks, "signatures").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("fps").alias("fps")), "copies")
    keyed = F.transform(F.slice("fps", 1, n), lambda x: x.bitwiseAND(F.lit(_signed((1 << bits) - 1))))
    nodes = copies.where(F.size("fps") > 0).select("node", keyed.alias("fps"), F.slice("fps", n + 1, CHECKS).alias("check"))
    found = links(nodes, RADIUS, bits=bits, most=int(APART * (bits + CHECKS * BITS)))
    groups = components(found)
    bodies = own.withColumnRenamed("doc_id", "node").join(groups.select("node").hint("merge"), "node", "left_semi")
    sets = materialise(bodies.mapInArrow(lambda it: _set_hashes(it, width), "node bigint, `set` binary").distinct(), "sets")
    sized = groups.join(sets.groupBy("node").agg(F.sum(F.octet_length("set")).alias("bytes")), "node")
    sizes = sized.groupBy("root").agg(F.greatest(F.count("*"), F.ceil(F.sum("bytes") / ROW)).alias("n"))
    rows = groups.join(sizes, "root").select(F.col("root").alias("key"), "node", "n")
    roots = components(alike_links(rows, sets, similarity, bucket))
    least = roots.groupBy("root").agg(F.min("node").alias("keep"))
    gone = roots.join(least, "root").where("node <> keep").select("node")
    kept = materialise(copies.join(gone, "node", "left_anti").select("node"), "kept")
    return docs.join(kept.hint("merge"), docs["doc_id"] == kept["node"], "left_semi").unionByName(docs.where("doc_id is null"))
