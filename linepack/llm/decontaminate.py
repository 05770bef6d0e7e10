"""Benchmark decontamination by a distributed positional inverted index.

The index is a Parquet table with one row for each block of documents: its terms, for each term the ordered list of its
places in the block, and the extent of each document. Blocks have bounded size and hold all postings of their documents,
so lists are intersected where they are stored: a frequent word has a list in every block, none of which is long, and no
posting is ever shuffled. Test windows come as bounded sets, each a pass over the index. Within a block a window starts
from the list of its rarest term; the lists of its other terms, rarer ones first, are met at their offsets until nothing
is left or the phrase stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, scratch
from ._words import byte_class, in_pieces, words_of

#: Bytes that part words: all ASCII but letters and digits.
KINDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Bytes of text of an index block, and of a set of test items that is sent to all tasks at once.
BLOCK, SET = 2 << 20, 8 << 20
#: Of the index's files: Parquet's writer keeps a row group in memory, Spark's reader a batch of up to all its rows, so it is
#: one block. Dictionaries of terms and places would be larger than these, and are given up only when they are full.
FILES = {"parquet.block.row.count.limit": 1} | {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("terms", "places")}
#: Places that are followed at once in a block.
AT_ONCE = 1 << 21


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, n = words_of(texts, KINDS)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    at = np.argsort(codes, kind="stable").astype(np.int32)
    count = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
    cols = [pa.array([number], pa.int64()), *(_list(x) for x in (ids, pa.array(n.astype(np.int32)), coded.dictionary, pa.array(count), pa.array(at)))]
    return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "words", "terms", "count", "places"])


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the postings of all terms of all whole texts: (block, ids, words, terms, count, places).

    ``ids`` and ``words`` give each document of the block and its number of words, in order; ``places`` the terms' lists,
    one after the other, of ``count`` places each, counted from the block's first word. Null and empty texts are documents
    without words. Ids may be null or repeat; other columns are not carried. A block has ``BLOCK`` bytes of text or one
    longer document, and is a row group of its own, so the memory of a task does not grow with the blocks of a file. An
    empty table gives an empty index.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in in_pieces(batch, 1, BLOCK):
                yield _block(number, piece.column(0), piece.column(1))
                number += 1

    schema = f"block bigint, ids array<{kind}>, words array<int>, terms array<binary>, count array<int>, places array<int>"
    path = path or scratch(own.sparkSession, "postings")
    own.mapInArrow(run, schema).write.options(**FILES).parquet(path)
    return read_index(own.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class _Tests(NamedTuple):
    """Windows over the words of a set of items: ``flat`` numbers ``terms``, window w is the ``size[w]`` words from ``start[w]`` on."""

    terms: pa.Array
    flat: np.ndarray
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _tests(texts: pa.Array, width: int) -> _Tests:
    words, n = words_of(texts, KINDS)
    coded = words.dictionary_encode()
    windows = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), windows)
    start = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(n) - n, windows)
    return _Tests(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), item, start, np.minimum(n, width)[item])


class _Postings:
    """One block's lists, and the windows all of whose terms it has."""

    def __init__(self, row: dict[str, pa.Array], tests: _Tests):
        count = row["count"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.places = row["places"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(count) - count
        self.keys = np.repeat(np.arange(len(count)), count) << 32 | self.places  # ordered by term, then place
        self.words = row["words"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.words) - self.words
        self.tests = tests
        own = pc.index_in(tests.terms, value_set=row["terms"])
        self.own = pc.fill_null(own, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = np.where(self.own < 0, 0, count[self.own]) if len(count) else np.zeros(len(self.own), np.int64)
        missing = np.concatenate(([0], np.cumsum(self.own[tests.flat] < 0)))
        self.met = np.flatnonzero(missing[tests.start + tests.size] == missing[tests.start])

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the list of ``term`` holds ``place``."""
        return self.next(term, place) == place

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of the list of ``term`` from ``place`` on, a place beyond the block if there is none."""
        at = np.minimum(np.searchsorted(self.keys, term << 32 | np.maximum(place, 0)), len(self.keys) - 1)
        found = self.keys[at]
        return np.where((found >> 32 == term) & (found & 0xFFFFFFFF >= place), found & 0xFFFFFFFF, 1 << 32)

    def rarest_first(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of one size, their terms and offsets with rarer terms first, in sets of ``AT_ONCE`` starting places."""
        t = self.tests
        for size in np.unique(t.size[self.met]).tolist():
            met = self.met[t.size[self.met] == size]
            words = t.flat[t.start[met, None] + np.arange(size)]
            order = np.argsort(self.n[words], axis=1, kind="stable")
            terms = self.own[np.take_along_axis(words, order, 1)]
            total = np.cumsum(self.n[np.take_along_axis(words, order[:, :1], 1)[:, 0]])
            at = 0
            while at < len(met):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
                yield met[at:end], terms[at:end], order[at:end], np.diff(total[at:end], prepend=total[at - 1] if at else 0)
                at = end

    def starting(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``terms`` repeated for each place of their first term, and those places."""
        row = np.repeat(np.arange(len(n)), n)
        return row, self.places[self.first[terms[row, 0]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]

    def slot(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, slot, place) of all exact occurrences inside one document."""
        out = [(np.zeros(0, np.int64),) * 3]
        for met, terms, offset, n in self.rarest_first():
            row, place = self.starting(terms, n)
            begin = place - offset[row, 0]
            row, begin = row[begin >= 0], begin[begin >= 0]
            for k in range(1, terms.shape[1]):
                stay = self.has(terms[row, k], begin + offset[row, k])
                row, begin = row[stay], begin[stay]
                if not len(row):
                    break
            slot = self.slot(begin)
            whole = begin + terms.shape[1] <= self.begin[slot] + self.words[slot]
            out.append((met[row[whole]], slot[whole], begin[whole]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def near(self, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, slot, place): spans from ``place`` on that hold all terms of a window in its size + ``slop`` words of one document."""
        out = [(np.zeros(0, np.int64),) * 3]
        for met, terms, _, n in self.rarest_first():
            span = terms.shape[1] + slop
            row, place = self.starting(terms, n)
            slot = self.slot(place)
            for back in range(span):  # the span begins so many words before the rarest term
                begin = place - back
                live = np.flatnonzero(begin >= self.begin[slot])
                end = np.minimum(begin + span, self.begin[slot] + self.words[slot])
                for k in range(1, terms.shape[1]):
                    live = live[self.next(terms[row[live], k], begin[live]) < end[live]]
                # a span begins at a term of the window: others hold no more than a later one
                live = live[(terms[row[live]] == self.token(begin[live])[:, None]).any(1)]
                out.append((met[row[live]], slot[live], begin[live]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def token(self, place: np.ndarray) -> np.ndarray:
        if not hasattr(self, "at"):
            self.at = np.empty(len(self.places), np.int64)
            self.at[self.places] = self.keys >> 32
        return self.at[place]


def _runs(p: _Postings, window: np.ndarray, slot: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, slot, begin, words) of maximal runs: windows of an item at one alignment that touch each other."""
    t = p.tests
    item, aligned, end = t.item[window], place - t.start[window], place + t.size[window]
    order = np.lexsort((place, aligned, item, slot))
    item, aligned, slot, place, end = (x[order] for x in (item, aligned, slot, place, end))
    opens = np.ones(len(item), bool)
    opens[1:] = (slot[1:] != slot[:-1]) | (item[1:] != item[:-1]) | (aligned[1:] != aligned[:-1]) | (place[1:] > end[:-1])
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(item))[: len(at)] - 1
    return item[at], slot[at], place[at] - p.begin[slot[at]], end[last] - place[at]


def _search(shared, width: int, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = None
        for batch in batches:
            if tests is None:
                names, texts = shared.value
                tests = _tests(texts, width)
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].values for c in ("words", "terms", "count", "places")}
                p = _Postings(row, tests)
                if slop is None:
                    item, slot, begin, n = _runs(p, *p.phrases())
                else:
                    window, slot, place = p.near(slop)
                    item, slot, begin, n = np.unique(np.stack([tests.item[window], slot, place - p.begin[slot], tests.size[window] + slop]), axis=1)
                if len(item):
                    block = pa.repeat(batch.column("block")[k], len(item))
                    yield pa.RecordBatch.from_arrays([block, pa.array(slot.astype(np.int32)), names.take(pa.array(item)), *(pa.array(x.astype(np.int32)) for x in (begin, n))], names=["block", "slot", "item_id", "begin", "n"])

    return run


def _sets(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of the items in sets of about ``SET`` bytes, each item in one of them."""
    own = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // SET)
    for k in range(n):
        part = own if n == 1 else own.where(F.expr(f"pmod(xxhash64(text, item_id), {n}) = {k}"))
        t = part.toArrow().combine_chunks()
        if t.num_rows:
            yield tuple(t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c] for c in ("item_id", "text"))


def matches(index: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(block, slot, item_id, begin, n): where windows of ``width`` item words stand in the documents of ``index``.

    An item of fewer words, but not none, is one window. Without ``slop`` phrases are exact, and windows of an item that
    touch at one alignment make one run from word ``begin`` on, ``n`` words long. With ``slop`` all distinct terms of a
    window stand, in any order, within its size + ``slop`` words of one document; ``begin`` is the first of these words and
    one of the terms, and ``n`` the size of the span. Every set of items is a pass over the index; a row comes once a set.
    """
    spark = index.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    schema = f"block bigint, slot int, item_id {kind}, begin int, n int"
    found: DataFrame | None = None
    for part in _sets(items, item_col, text_col):
        shared = spark.sparkContext.broadcast(part)  # of about SET bytes
        met = index.select("block", "words", "terms", "count", "places").mapInArrow(_search(shared, width, slop), schema)
        found = met if found is None else found.unionByName(met)
    return found if found is not None else spark.createDataFrame([], schema)


def documents_of(index: DataFrame) -> DataFrame:
    """(block, slot, doc_id, n_words) of all documents of the index."""
    each = index.select("block", F.posexplode(F.arrays_zip("ids", "words")).alias("slot", "d"))
    return each.select("block", "slot", F.col("d.ids").alias("doc_id"), F.col("d.words").cast("long").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``.

    A word is hit inside any occurrence of a window of an item of ``items`` (item_id, text); hits are counted once however
    many windows cover them. ``items_sha256`` digests the ids of the items met, each once, sorted as strings and joined by
    commas, the empty string for none. Repeated documents are rows of their own; null and empty texts have no words; items
    without words meet nothing; a null item_id stands as an empty string. Empty tables of documents give an empty result.
    """
    index = build_index(docs)
    found = materialise(matches(index, items, width), "phrases")
    w = Window.partitionBy("block", "slot").orderBy("begin", "n")
    end = F.col("begin") + F.col("n")
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = found.withColumn("new", F.greatest(end - F.greatest("begin", before), F.lit(0)))
    named = F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))))
    hits = new.groupBy("block", "slot").agg(F.sum("new").alias("n_hit"), named.alias("items"))
    out = documents_of(index).join(hits, ["block", "slot"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    items_met = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items_met).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_met, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
