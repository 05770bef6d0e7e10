"""Source divergence audit: how far each source's vocabulary lies from every other's in its language.

Counts are sparse rows (lang, term, source). The kept terms of a language are dealt into chunks of bounded size; within a
chunk each source's counts are a segment tree over term ids, and all sources' trees share one table of nodes: a node is
named by its children, so equal count subtrees are one node wherever they lie. Two trees are walked together, level by
level. Equal pairs of nodes at a level become one pair with a multiplicity, so each is opened and priced once, however
often a source lacks the same rare terms.

All arithmetic is that of whole numbers: a share is p = 1 + floor(10^9 (count + 1) / (N + V)), for V kept terms of the
language and N occurrences of them, and a price floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from ._words import byte_class, in_pieces, words_of

#: Bytes that part terms: all ASCII but letters.
KINDS = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Bytes of text counted at once, counts of a chunk (about), and sources whose pairs one task prices.
AT_ONCE, CHUNK, SOURCES = 8 << 20, 1 << 16, 64
ONE = 1_000_000_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of (lang, source, text), summed over pieces of batches; a group without terms has a null one."""
    for batch in batches:
        for piece in in_pieces(batch, 2, AT_ONCE):
            groups = pa.StructArray.from_arrays([piece.column(0), piece.column(1)], names=["lang", "source"])
            names = pc.binary_join_element_wise(pc.cast(pc.binary_length(piece.column(0)), pa.string()), piece.column(0), piece.column(1), ":").dictionary_encode()
            of = names.indices.to_numpy().astype(np.int64)
            some = np.zeros(len(names.dictionary), np.int64)
            some[of] = np.arange(len(of))  # a row of each group
            words, n = words_of(piece.column(2), KINDS)
            coded = words.dictionary_encode()
            size = max(len(coded.dictionary), 1)
            doc = np.repeat(np.arange(len(n)), n)
            keys, count = np.unique(doc * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            keys, at, docs = np.unique(of[keys // size] * size + keys % size, return_inverse=True, return_counts=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, count)
            bare = np.setdiff1d(np.arange(len(some)), keys // size)
            group = groups.take(pa.array(some[np.concatenate((keys // size, bare))]))
            terms = pa.concat_arrays([coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.nulls(len(bare), pa.string())])
            full = [np.concatenate((x, np.zeros(len(bare), np.int64))) for x in (total, docs)]
            yield pa.RecordBatch.from_arrays([group.field(0), group.field(1), terms, *map(pa.array, full)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; a null term marks each group that occurs.

    Null text, lang and source count as empty. Partial sums are taken in batches; the sums lie by (lang, term).
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = own.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p in whole numbers: long division in three steps of a thousand, so nothing overflows below 9 * 10^15 occurrences."""
    rest, out = (count + 1), F.lit(0).cast("long")
    for _ in range(3):
        digit = F.call_function("div", rest * 1000, total + kept)
        out, rest = out * 1000 + digit, rest * 1000 - digit * (total + kept)
    return out + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays; ``total`` is N + V."""
    rest, out = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


class Forest:
    """Segment trees over the columns of ``counts`` (a tree for each row) with shared nodes.

    ``leaves`` are the distinct counts; ``levels[k]`` has the two children of each distinct node of 2^(k + 1) terms.
    The columns are filled up to a power of two by a leaf of -1, which costs nothing.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(counts.shape[1] - 1, 0).bit_length()
        filled = np.full((len(counts), width), -1, np.int64)
        filled[:, : counts.shape[1]] = counts
        self.leaves, at = np.unique(filled, return_inverse=True)
        at, size = at.reshape(filled.shape), len(self.leaves)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while at.shape[1] > 1:
            nodes, below = np.unique(at[:, ::2] * size + at[:, 1::2], return_inverse=True)
            self.levels.append((nodes // size, nodes % size))
            at, size = below.reshape(len(counts), -1), len(nodes)
        self.roots = at[:, 0]

    def leaf_pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, count in a, count in b, multiplicity): the trees of rows ``a`` and ``b`` walked together."""
        pair, x, y, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for left, right in reversed(self.levels):
            pair, times = np.tile(pair, 2), np.tile(times, 2)
            x, y = np.concatenate((left[x], right[x])), np.concatenate((left[y], right[y]))
            order = np.lexsort((y, x, pair))
            pair, x, y, times = pair[order], x[order], y[order], times[order]
            first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            pair, x, y, times = pair[first], x[first], y[first], np.add.reduceat(times, first)
        p, q = self.leaves[x], self.leaves[y]
        return pair[p >= 0], p[p >= 0], q[p >= 0], times[p >= 0]


def _price_chunk(key: tuple, t: pa.Table) -> pa.Table:
    """Prices of the pairs of one chunk: rows without a term name the language's sources, their N and V."""
    bare = t.filter(pc.is_null(t["term"]))
    order = np.argsort(np.array(bare["source"].to_pylist(), object), kind="stable")
    names = bare["source"].combine_chunks().take(pa.array(order))
    total = bare["total"].to_numpy()[order] + bare["kept"].to_numpy()[order]
    full = t.filter(pc.is_valid(t["term"]))
    terms = full["term"].combine_chunks().dictionary_encode()
    column = terms.indices.to_numpy(zero_copy_only=False)
    row = pc.index_in(full["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    counts = np.zeros((len(names), len(terms.dictionary)), np.int64)
    counts[row, column] = full["n"].to_numpy()
    # terms of like counts, and terms that the same sources lack, lie together: more subtrees are equal
    counts = counts[:, np.lexsort((*counts[::-1], counts.sum(0)))] if counts.size else counts
    out: list[list[np.ndarray]] = [[], [], []]
    forest = Forest(counts) if counts.shape[1] else None
    block = key[2].as_py() * SOURCES
    for i in range(block, min(block + SOURCES, len(names))):
        others = np.arange(i + 1, len(names))
        if not len(others):
            continue
        there, back = np.zeros(len(others), np.int64), np.zeros(len(others), np.int64)
        if forest is not None:
            pair, x, y, times = forest.leaf_pairs(np.full(len(others), i), others)
            p, q = _shares(x, np.full(len(x), total[i])), _shares(y, total[others[pair]])
            np.add.at(there, pair, (p - q) ** 2 // q * times)
            np.add.at(back, pair, (p - q) ** 2 // p * times)
        for cols in ((np.full(len(others), i), others, there), (others, np.full(len(others), i), back)):
            for kept, col in zip(out, cols, strict=True):
                kept.append(col)
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    lang = pa.repeat(key[0], len(a)).cast(pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(value)})


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, all): the counts of terms in ``least`` documents of their language, with their sum over sources."""
    both = Window.partitionBy("lang", "term")
    met = counts.where("term is not null").withColumn("in", F.sum("docs").over(both)).withColumn("all", F.sum("n").over(both))
    return met.where(F.col("in") >= least).select("lang", "term", "source", "n", "all")


def group_totals(counts: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, total) of every group that occurs, and (lang, kept, lang_total) of every language."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    # one row of each term counts it: that of its smallest source
    of = kept.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    langs = groups.select("lang").distinct().join(of, "lang", "left")
    return groups, langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))


def pair_divergence(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each ordered pair of a language's sources the prices of all kept terms, summed."""
    # a term's magnitude and a hash choose its chunk: terms of like counts share chunks, and chunks have bounded sizes
    placed = kept.withColumn("tier", F.floor(F.log2("all")).cast("int"))
    sizes = placed.groupBy("lang", "tier").agg(F.count("*").alias("rows"), F.count_distinct("term").alias("terms"))
    blocks = (F.floor((F.col("sources") - 1) / SOURCES) + 1).cast("int").alias("blocks")
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    chunks = F.ceil(F.greatest(F.col("rows") / CHUNK, F.col("terms") * F.col("sources") / (CHUNK * 16))).cast("int").alias("chunks")
    # a chunk's table has a cell for each source and term; written, so that Spark plans with the measured size
    sizes = materialise(sizes.join(sources, "lang").select("lang", "tier", chunks, blocks), "chunks")
    chunk = lambda c: (F.col("tier").cast("long") * (1 << 40) + c).alias("chunk")
    full = placed.join(sizes, ["lang", "tier"]).select("lang", chunk(F.expr("pmod(xxhash64(term, 13), chunks)")), "blocks", "term", "source", "n")
    known = sizes.select("lang", "tier", "blocks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")).select("lang", chunk(F.col("c").cast("long")), "blocks")
    bare = langs.where("kept = 0").join(sources, "lang").select("lang", F.lit(-1).cast("long").alias("chunk"), blocks)
    known = known.unionByName(bare).join(groups.join(langs, "lang"), "lang").select("lang", "chunk", "blocks", F.lit(None).cast("string").alias("term"), "source", "total", "kept")
    rows = known.unionByName(full, allowMissingColumns=True).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    priced = rows.select("lang", "chunk", "block", "term", "source", "n", "total", "kept").groupBy("lang", "chunk", "block")
    priced = priced.applyInArrow(_price_chunk, "lang string, source string, item string, value bigint")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source uses more than its language does, and their prices."""
    met = kept.join(groups, ["lang", "source"]).join(langs, "lang")
    p, q = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("all"), F.col("lang_total"), F.col("kept"))
    met = met.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return met.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs`` (text, lang, source).

    A language keeps the terms in at least ``least`` of its documents; rows that repeat are documents of their own. Part
    ``pair`` has every other source of the language, part ``term`` the first ``ranks`` terms with a share above the
    language's. Ranks count from 1 by falling value, ties by item in byte order. Null text, lang and source count as empty.
    Other columns are not used. An empty table gives an empty result, and so does a language of one source in part
    ``pair``; without kept terms all its pairs have value 0.
    """
    counts = materialise(term_counts(docs), "term-counts")
    kept = materialise(kept_terms(counts, least), "kept-terms")
    groups, langs = (materialise(x, name) for x, name in zip(group_totals(counts, kept), ("groups", "langs"), strict=True))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(w)
    pairs = pair_divergence(kept, groups, langs).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = term_divergence(kept, groups, langs).withColumn("rank", rank).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
