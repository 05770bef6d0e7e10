"""Block layout: a document's lines as warm-up, parallel threads and tail, in one re-ordered row.

A block is a line with its newline run, and a thread. Lengths, roles, schedules and step counts need a document's array
of lengths alone and no shuffle; the token grain has a row for each position, sorted within its document where that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merges import NO, PURE


@dataclass(frozen=True)
class Ids:
    """Ids of the special tokens and the distance between threads' positions."""

    bos: int = 1
    sot: int = 2
    eot: int = 3
    sot_tail: int = 5
    stride: int = 256


IDS = Ids()


def split_blocks_by_class(tokens: Column, classes: Column) -> Column:
    """Blocks of a token array: after a token with a newline a PURE token extends the run and any other opens a block.

    The places at which blocks open are found first and the blocks cut between them, so an array is copied once.
    """
    def cut(x: Column) -> Column:
        n = F.size(x["t"])
        opens = lambda i: (i == 1) | ((F.get(x["c"], i - 2) != "NO") & (F.get(x["c"], i - 1) != "PURE"))
        at = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), opens)).otherwise(F.array().cast("array<int>"))
        # bound by an array of one, so that it is not evaluated for each block
        return F.element_at(F.transform(F.array(at), lambda a: F.transform(a, lambda i, k: F.slice(x["t"], i, F.coalesce(F.get(a, k + 1), n + 1) - i))), 1)

    return F.element_at(F.transform(F.array(F.struct(tokens.alias("t"), classes.alias("c"))), cut), 1)


def token_blocks(df: DataFrame, classes: list[int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, blocks, lens): documents of token ids cut into blocks by the tokens' newline classes.

    ``classes`` gives NO, PURE or TRAIL (``merges``) by id; ids beyond it are NO. The rule is that of
    ``split_blocks_by_class``, on whole Arrow batches. Null and empty documents have no block.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[key]
    known = np.array(classes, np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            of = np.where(flat < len(known), known[np.minimum(flat, len(known) - 1)], NO)
            ends = np.cumsum(tokens)
            opens = np.zeros(len(flat), bool)
            opens[1:] = (of[:-1] != NO) & (of[1:] != PURE)
            opens[(ends - tokens)[tokens > 0]] = True
            at = np.flatnonzero(opens)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32)))
            cuts = pa.array(np.searchsorted(at, np.concatenate(([0], ends))).astype(np.int32))
            sizes = pa.array(np.diff(np.append(at, len(flat))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, lists), pa.ListArray.from_arrays(cuts, sizes)], names=[key, "blocks", "lens"])

    return df.select(key, ids).mapInArrow(run, f"{key} {kind}, blocks array<array<int>>, lens array<int>")


def assign_roles(df: DataFrame, warm: int, lengths: str = "lens") -> DataFrame:
    """Add n_blocks, n_warm, n_middle, has_tail: the last of two or more blocks is the tail; of the others those are
    warm-up before which at most ``warm`` tokens lie, the rest is middle."""
    n = F.size(lengths)
    rest = F.when(n >= 2, F.slice(F.col(lengths), F.lit(1), n - 1)).otherwise(F.col(lengths))
    before = F.aggregate(rest, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] <= warm, 1).otherwise(0)).alias("n")))
    out = df.withColumn("n_blocks", n).withColumn("has_tail", n >= 2).withColumn("n_warm", F.when(n > 0, before["n"]).otherwise(0))
    return out.withColumn("n_middle", F.col("n_blocks") - F.col("n_warm") - F.col("has_tail").cast("int"))


def row_length(lengths: str = "lens") -> Column:
    """Positions of the row: content, one anchor a block and one more for a tail."""
    content = F.aggregate(F.col(lengths), F.lit(0), lambda a, x: a + x)
    return content + 1 + (F.col("n_warm") - 1) + F.col("n_middle") + 2 * F.col("has_tail").cast("int")


def fits(df: DataFrame, most: int, lengths: str = "lens") -> DataFrame:
    """Documents whose whole row has at most ``most`` positions; decided from lengths, before any layout."""
    return df.where(row_length(lengths) <= most)


def starts(middle: Column, cap: int | None) -> Column:
    """The step at which each middle thread starts, and after them the tail candidate.

    Uncapped, thread t starts at step t. With a cap a thread starts at the first step after the last start at which
    fewer than ``cap`` are active: 1 after the ``cap``-th largest earlier finish. The fold keeps those finishes alone.
    """
    if cap is None:
        return F.sequence(F.lit(0), F.size(middle))
    if cap < 1:
        raise ValueError("the cap must be positive")

    def step(acc: Column, length: Column) -> Column:
        nxt = F.greatest(F.coalesce(F.try_element_at(acc["s"], F.lit(-1)), F.lit(-1)) + 1, F.coalesce(F.try_element_at(acc["f"], F.lit(cap)) + 1, F.lit(0)))
        finishes = F.slice(F.sort_array(F.concat(acc["f"], F.array(nxt + length)), asc=False), 1, cap)
        return F.struct(F.concat(acc["s"], F.array(nxt)).alias("s"), finishes.alias("f"))

    none = F.struct(F.array().cast("array<int>").alias("s"), F.array().cast("array<int>").alias("f"))
    return F.aggregate(F.concat(middle, F.array(F.lit(0))), none, step, lambda a: a["s"])


#: Positions that a task lays out at once, besides those of one document.
AT_ONCE = 200_000


def depth_buckets(depth: np.ndarray) -> np.ndarray:
    """``depth_bucket`` of an array."""
    return np.searchsorted([1, 2, 3, 5, 9, 17], depth, side="right") - 1


def _lay_out(batch: pa.RecordBatch, payloads: tuple[str, ...], more: tuple[str, ...], ids: Ids) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """The positions of some documents (n_warm, n_middle, has_tail, starts, blocks, payloads), in row order.

    Gives each position's document, the positions of each document, and the columns by name.
    """
    number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = lambda n: np.cumsum(n) - n
    n_warm, n_middle, has_tail = number("n_warm"), number("n_middle"), number("has_tail")
    blocks = batch.column("blocks")
    n, of = lengths(blocks), blocks.flatten()
    size, words = lengths(of), of.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts_, n_starts = batch.column("starts").flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths(batch.column("starts"))
    # one row for each thread
    doc = np.repeat(np.arange(len(n)), n)
    thread = np.arange(len(doc)) - np.repeat(before(n), n)
    last, warm = thread == n[doc] - 1, thread < n_warm[doc]
    tail = last & (has_tail[doc] > 0)
    stage = np.where(warm, thread, n_warm[doc] + (tail & (n_middle[doc] > 0)))
    begin = starts_[before(n_starts)[doc] + np.maximum(thread - n_warm[doc], 0)]
    lead = 1 + tail.astype(np.int64)
    # one for each position, in source order
    long = size + lead
    at = np.repeat(np.arange(len(doc)), long)
    local = np.arange(len(at)) - np.repeat(before(long), long)
    word = before(size)[at] + local - lead[at]
    token = np.where(local == 0, np.where(thread[at] == 0, ids.bos, ids.sot), ids.sot_tail)
    inside = local >= lead[at]
    token[inside] = words[word[inside]]
    target = np.append(token[1:], 0)
    ends = np.cumsum(long) - 1
    target[ends] = np.where(last, ids.bos, ids.eot)
    phase = np.where(warm[at], 0, np.where(tail[at] & (local > 0), 2, 1))
    step = np.where(phase == 0, thread[at], np.where(phase == 2, local, begin[at] + local))
    order = np.lexsort((np.where(phase == 0, local, thread[at]), step, phase, doc[at]))
    whose = doc[at][order]
    each = np.bincount(whose, minlength=len(n))
    row_pos = np.arange(len(order)) - np.repeat(before(each), each)
    own = {"row_pos": row_pos, "phase": phase[order], "step": step[order], "token": token[order], "thread": thread[at][order], "local_step": local[order],
           "stage": stage[at][order], "rope": (thread[at] * ids.stride + local)[order], "target": target[order]}
    out = {k: pa.array(x.astype(np.int32)) for k, x in own.items()}
    for name in payloads:  # a token's own value; anchors have none
        values = batch.column(name).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        full = np.zeros(len(at), np.int32)
        full[inside] = values[word[inside]]
        out[name] = pa.array(full[order], mask=~inside[order])
    if not more:
        return whose, each, out
    place = np.empty(len(order), np.int64)
    place[order] = row_pos
    end = np.zeros(len(at), bool)
    end[ends] = True
    ahead = lambda x: np.append(x[1:], x[:1])
    content = ~end & ahead(inside)  # the next of the thread is a token of the text
    found: dict[str, np.ndarray] = {}
    if "next_pos" in more:
        out["next_pos"] = pa.array(ahead(place)[order].astype(np.int32), mask=end[order])
    if "source_index" in more or "target_row" in more:
        index = np.cumsum(inside) - 1 - np.repeat(before(np.bincount(doc, weights=size, minlength=len(n)).astype(np.int64)), each)
        found["source_index"] = np.where(content, ahead(index), -1)[order]
        found["target_row"] = np.where(content, ahead(place), -1)[order]
    if {*LABELS} & {*more}:
        role = np.where(warm, 0, np.where(thread < (n_warm + n_middle)[doc], 1, 2))[at]
        anchor = np.isin(target, (ids.bos, ids.sot, ids.eot, ids.sot_tail))
        found["line_role"], found["is_anchor_target"] = role[order], anchor[order]
        found["depth_in_line"] = np.where(end, -1, depth_buckets(local + 1))[order]
        found["line_start"] = (~end & ~anchor & (local + 1 == np.where(role == 2, 2, 1)))[order]
        width = np.ones(len(at), np.int64)
        wave = np.flatnonzero(role == 1)
        _, which, count = np.unique(doc[at][wave] << 32 | step[wave], return_inverse=True, return_counts=True)
        width[wave] = count[which]
        found["wave_width"] = width[order]
    first = np.zeros(len(order), bool)
    first[before(each)[each > 0]] = True
    if "gen_step" in more:
        sub = np.where(own["phase"] == 1, 0, own["local_step"])
        opens = first.copy()
        opens[1:] |= (np.diff(own["phase"]) != 0) | (np.diff(own["step"]) != 0) | (np.diff(sub) != 0)
        group = np.cumsum(opens)
        third = group[np.minimum(before(each) + 2, len(order) - 1)][whose]
        found["gen_step"] = np.where(row_pos < 2, 0, group - third + 1)
    if "segment" in more:
        cut = first.copy()
        cut[1:] |= (np.diff(own["thread"]) != 0) | (np.diff(own["stage"]) != 0) | (np.diff(own["local_step"]) != 1) | (np.diff(own["rope"]) != 1)
        run = np.cumsum(cut)
        found["segment"] = run - run[np.flatnonzero(first)][np.cumsum(first) - 1]
    return whose, each, out | {k: pa.array(x.astype(np.int32)) for k, x in found.items() if k in more}


_PLACES = ("row_pos", "phase", "step", "token", "thread", "local_step", "stage", "rope", "target")
#: Slice labels of a position: see ``slice_labels``.
LABELS = ("line_role", "depth_in_line", "line_start", "is_anchor_target", "wave_width")
#: What the layout can tell of a position besides its place.
MORE = ("next_pos", "source_index", "target_row", *LABELS, "gen_step", "segment")


def _laid_out(df: DataFrame, keys: tuple[str, ...], ids: Ids, cap: int | None, blocks: str, payloads: tuple[str, ...], more: tuple[str, ...], arrays: bool, only: tuple[str, ...] | None = None) -> DataFrame:
    if unknown := {*more} - {*MORE}:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    middle = F.transform(F.slice(F.col(blocks), F.col("n_warm") + 1, F.col("n_middle")), lambda b: F.size(b))
    kept = (*keys, "n_warm", "n_middle", "has_tail")
    docs = df.where(F.size(blocks) > 0).select(*kept, starts(middle, cap).alias("starts"), F.col(blocks).alias("blocks"), *payloads)
    names = [k for k in (*_PLACES, *payloads, *(k for k in MORE if k in more)) if only is None or k in only]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("blocks")
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(of.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 2)))
            n = np.cumsum(pc.list_value_length(of).to_numpy(zero_copy_only=False))
            count = np.diff(np.concatenate(([0], ends[n])))  # positions of each document at most
            at = 0
            while at < len(count):
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(count[at:]), AT_ONCE, side="right")))
                some = batch.slice(at, end - at)
                whose, each, cols = _lay_out(some, payloads, more, ids)
                if arrays:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32))
                    made = [*(some.column(k) for k in kept), *(pa.ListArray.from_arrays(offsets, cols[k]) for k in names)]
                else:
                    of_doc = pa.array(whose)
                    made = [*(some.column(k).take(of_doc) for k in kept), *(cols[k] for k in names)]
                yield pa.RecordBatch.from_arrays(made, names=[*kept, *names])
                at = end

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in kept] + [f"{k} {'array<int>' if arrays else 'int'}" for k in names])
    return docs.mapInArrow(run, schema)


def positions(df: DataFrame, *keys: str, ids: Ids = IDS, cap: int | None = None, blocks: str = "blocks", payloads: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """Token grain of the rows of ``df``: (keys, n_warm, n_middle, has_tail, row_pos, phase, step, token, thread, local_step, stage, rope, target).

    ``blocks`` is an array of token arrays with its roles assigned. Phase 0 is the warm-up in block order; phase 1 has
    the middle threads and the tail candidate, by step and thread; phase 2 is the tail. A target is the next token of
    the thread; a thread's last target is ``eot``, and ``bos`` for the last line. Start steps are folded once a document;
    a document is sorted where it is, in Arrow batches of bounded size, so no token is shuffled. Rows of a null or empty
    ``blocks`` have no position.

    ``payloads`` are columns of the shape of ``blocks``: each value goes with its token, and anchors have none (null).
    ``more`` asks for columns of ``MORE``, which hold what ``next_in_thread``, ``position_labels``, ``slice_labels``,
    ``generation_steps`` and ``row_segments`` say of stored positions; here they cost no window.
    """
    return _laid_out(df, keys, ids, cap, blocks, payloads, more, False)


def rows(df: DataFrame, *keys: str, ids: Ids = IDS, cap: int | None = None, blocks: str = "blocks", payloads: tuple[str, ...] = (), more: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """Array grain of ``positions``: a row for each document, each of its columns (or ``only`` some) as an array in row order."""
    return _laid_out(df, keys, ids, cap, blocks, payloads, more, True, only)


def next_in_thread(pos: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add next_pos: the row position of the next position in the thread, null at its end."""
    return pos.withColumn("next_pos", F.lead("row_pos").over(Window.partitionBy(key, "thread").orderBy("local_step")))


def step_groups(pos: DataFrame, *keys: str) -> DataFrame:
    """(keys, phase, step, local_step or 0, size): positions decoded in one step."""
    alone = F.when(F.col("phase") == 1, 0).otherwise(F.col("local_step"))
    return pos.groupBy(*keys, "phase", "step", alone.alias("sub")).agg(F.count("*").cast("int").alias("size"))


def step_count(cap: int | None = None, lengths: str = "lens") -> Column:
    """Decode steps of a document from its lengths: warm-up positions one by one, the middle by schedule, the tail one by one."""
    warm = F.aggregate(F.slice(F.col(lengths), F.lit(1), F.col("n_warm")), F.lit(0), lambda a, x: a + x + 1)
    middle = F.slice(F.col(lengths), F.col("n_warm") + 1, F.col("n_middle"))
    begun = starts(middle, cap)
    ends = F.zip_with(middle, begun, lambda x, s: x + s)  # the tail candidate has no length: null
    last = F.greatest(F.coalesce(F.array_max(ends), F.lit(-1)), F.when(F.col("has_tail"), F.try_element_at(begun, F.lit(-1))).otherwise(-1))
    tail = F.when(F.col("has_tail"), F.try_element_at(F.col(lengths), F.lit(-1)) + 1).otherwise(0)
    return warm + last + 1 + tail


def flat_step_count(cap: int | None = None, lengths: str = "lens") -> Column:
    """Decode steps if middle lines went in batches of ``cap`` (all at once without one), each as long as its longest line and an anchor."""
    warm = F.aggregate(F.slice(F.col(lengths), F.lit(1), F.col("n_warm")), F.lit(0), lambda a, x: a + x + 1)
    middle = F.slice(F.col(lengths), F.col("n_warm") + 1, F.col("n_middle"))
    if cap is None:
        flat = F.coalesce(F.array_max(middle) + 1, F.lit(0))
    else:
        batches = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(middle) / cap).cast("int") - 1, F.lit(0))), lambda b: F.coalesce(F.array_max(F.slice(middle, b * cap + 1, F.lit(cap))) + 1, F.lit(0)))
        flat = F.aggregate(batches, F.lit(0), lambda a, x: a + x)
    tail = F.when(F.col("has_tail"), F.try_element_at(F.col(lengths), F.lit(-1)) + 2).otherwise(0)
    return warm + flat + tail


def yield_summary(df: DataFrame, cap: int | None = None, lengths: str = "lens") -> DataFrame:
    """Add per document: tokens with and without specials, steps both ways, lines and tokens of each role."""
    part = lambda a, n: F.aggregate(F.slice(F.col(lengths), a, n), F.lit(0), lambda s, x: s + x)
    tail = F.when(F.col("has_tail"), F.try_element_at(F.col(lengths), F.lit(-1))).otherwise(0)
    out = df.withColumn("tokens_incl", row_length(lengths)).withColumn("tokens_excl", F.aggregate(F.col(lengths), F.lit(0), lambda s, x: s + x))
    out = out.withColumn("steps", step_count(cap, lengths)).withColumn("flat_steps", flat_step_count(cap, lengths))
    return out.withColumn("warm_tokens", part(F.lit(1), F.col("n_warm"))).withColumn("middle_tokens", part(F.col("n_warm") + 1, F.col("n_middle"))).withColumn("tail_tokens", tail)


def token_yield(summary: DataFrame, *groups: str) -> DataFrame:
    """Corpus totals and averages of tokens a decode step; 0 where there are no steps."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    return summary.groupBy(*groups).agg(
        F.count("*").alias("docs"), s("tokens_incl").alias("tokens_incl"), s("tokens_excl").alias("tokens_excl"), s("steps").alias("steps"), s("flat_steps").alias("flat_steps"),
        ratio("tokens_incl", "steps").alias("incl_per_step"), ratio("tokens_excl", "steps").alias("excl_per_step"),
        ratio("tokens_incl", "flat_steps").alias("incl_per_flat_step"), ratio("tokens_excl", "flat_steps").alias("excl_per_flat_step"),
        s("n_warm").alias("warm_lines"), s("n_middle").alias("middle_lines"), s(F.col("has_tail").cast("int")).alias("tail_lines"),
        s("warm_tokens").alias("warm_tokens"), s("middle_tokens").alias("middle_tokens"), s("tail_tokens").alias("tail_tokens"),
    )


def generation_steps(pos: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add gen_step: the first two positions are step 0, later groups count from 1."""
    order = [F.col("phase"), F.col("step"), F.when(F.col("phase") == 1, 0).otherwise(F.col("local_step"))]
    ranked = pos.withColumn("__g", F.dense_rank().over(Window.partitionBy(key).orderBy(*order)))
    first = F.min(F.when(F.col("row_pos") >= 2, F.col("__g"))).over(Window.partitionBy(key))
    return ranked.withColumn("gen_step", F.when(F.col("row_pos") < 2, 0).otherwise(F.col("__g") - first + 1)).drop("__g")


def trace(pos: DataFrame, vocab: DataFrame, ids: Ids = IDS, key: str = "doc_id") -> DataFrame:
    """Add tag (what an anchor opens, null for content) and text (from ``vocab``: id, text; null where unknown)."""
    tag = F.when(F.col("local_step") > 0, F.when((F.col("token") == ids.sot_tail) & (F.col("local_step") == 1), "block_open")).when(F.col("thread") == 0, "stream_start").otherwise("thread_start")
    named = pos.join(vocab.select(F.col("id").alias("token"), "text"), "token", "left")
    return named.withColumn("tag", tag)


def row_segments(pos: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segment, thread, stage, first_pos, last_pos, first_step, last_step): runs of positions that follow each other in one thread and stage."""
    w = Window.partitionBy(key).orderBy("row_pos")
    same = (F.lag("thread").over(w) == F.col("thread")) & (F.lag("stage").over(w) == F.col("stage")) & (F.lag("local_step").over(w) + 1 == F.col("local_step")) & (F.lag("rope").over(w) + 1 == F.col("rope"))
    cut = pos.withColumn("__cut", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("segment", F.sum("__cut").over(w) - 1)
    return cut.groupBy(key, "segment").agg(F.min("thread").alias("thread"), F.min("stage").alias("stage"), F.min("row_pos").alias("first_pos"), F.max("row_pos").alias("last_pos"), F.min("local_step").alias("first_step"), F.max("local_step").alias("last_step"))


def logical_lines(pos: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, thread, n, spans): each thread's row positions as compact ranges, such as ``0-3,7``."""
    w = Window.partitionBy(key, "thread").orderBy("row_pos")
    runs = pos.withColumn("__run", F.col("row_pos") - F.row_number().over(w)).groupBy(key, "thread", "__run").agg(F.min("row_pos").alias("a"), F.max("row_pos").alias("b"))
    name = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    parts = F.array_sort(F.collect_list(F.struct("a", name.alias("s"))))
    return runs.groupBy(key, "thread").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"), F.array_join(F.transform(parts, lambda p: p["s"]), ",").alias("spans"))


def _each_row(rows: DataFrame, key: str, columns: tuple[str, ...], schema: str, made) -> DataFrame:
    """``made`` of some rows at once: the document of each position and its ``columns``; gives documents and columns of ``schema``."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, AT_ONCE + (ends[at - 1] if at else 0), side="right")))
                some = batch.slice(at, end - at)
                each = np.diff(np.append(0, ends[at:end] - (ends[at - 1] if at else 0)))
                doc, cols = made(np.repeat(np.arange(len(each)), each), *(some.column(k + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(columns))))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(doc)), *cols.values()], names=[key, *cols])
                at = end

    return rows.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, {schema}")


def segments_of_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``row_segments`` of array rows with their ``segment``: each is cut where it is, and no position is shuffled."""
    columns = ("segment", "row_pos", "thread", "stage", "local_step")

    def made(doc: np.ndarray, segment: np.ndarray, row_pos: np.ndarray, thread: np.ndarray, stage: np.ndarray, local_step: np.ndarray):
        cut = np.ones(len(doc), bool)
        cut[1:] = (np.diff(doc) != 0) | (np.diff(segment) != 0)
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(doc)) - 1
        own = {"segment": segment[a], "thread": thread[a], "stage": stage[a], "first_pos": row_pos[a], "last_pos": row_pos[b], "first_step": local_step[a], "last_step": local_step[b]}
        return doc[a], {k: pa.array(x.astype(np.int32)) for k, x in own.items()}

    return _each_row(rows, key, columns, "segment int, thread int, stage int, first_pos int, last_pos int, first_step int, last_step int", made)


def lines_of_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``logical_lines`` of array rows: each document's threads are gathered where it is, and no position is shuffled."""
    def made(doc: np.ndarray, row_pos: np.ndarray, thread: np.ndarray):
        order = np.lexsort((row_pos, thread, doc))
        doc, p, t = doc[order], row_pos[order], thread[order]
        opens = np.ones(len(doc), bool)
        opens[1:] = (np.diff(doc) != 0) | (np.diff(t) != 0)
        cut = opens.copy()
        cut[1:] |= np.diff(p) != 1
        a = np.flatnonzero(cut)
        first, last = p[a], p[np.append(a[1:], len(p)) - 1]
        text = lambda x: pa.array(x).cast(pa.string())
        names = pc.if_else(pa.array(first == last), text(first), pc.binary_join_element_wise(text(first), text(last), "-"))
        at = np.flatnonzero(opens)
        spans = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(a, at), len(a)).astype(np.int32)), names), ",")
        return doc[at], {"thread": pa.array(t[at].astype(np.int32)), "n": pa.array(np.diff(np.append(at, len(p))).astype(np.int64)), "spans": spans}

    return _each_row(rows, key, ("row_pos", "thread"), "thread int, n bigint, spans string", made)


def row_windows(pos: DataFrame, spans: DataFrame, key: str = "doc_id", head: int = 40, around: int = 12, last: int = 80) -> DataFrame:
    """Rows (..., window): the first ``head`` positions, those ``around`` the span [start, end) of ``spans``, the ``last`` ones."""
    total = pos.groupBy(key).agg((F.max("row_pos") + 1).alias("__n"))
    met = pos.join(total, key).join(spans.select(key, "start", "end"), key, "left")
    p = F.col("row_pos")
    where = F.array_compact(F.array(F.when(p < head, "head"), F.when(p.between(F.col("start") - around, F.col("end") - 1 + around), "answer"), F.when(p >= F.col("__n") - last, "tail")))
    return met.withColumn("window", F.explode(where)).drop("__n", "start", "end")


def depth_bucket(depth: Column) -> Column:
    """0 to 5 for depths 1, 2, 3-4, 5-8, 9-16, 17 on; -1 below 1."""
    return F.when(depth < 1, -1).when(depth == 1, 0).when(depth == 2, 1).when(depth <= 4, 2).when(depth <= 8, 3).when(depth <= 16, 4).otherwise(5)


def slice_labels(pos: DataFrame, ids: Ids = IDS, key: str = "doc_id") -> DataFrame:
    """Add line_role (0 warm-up, 1 middle, 2 tail), depth_in_line, line_start, is_anchor_target and wave_width.

    ``pos`` carries n_warm, n_middle and has_tail. Labels stand at the position that predicts: depth and line start are
    the target's. A tail's content starts at depth 2, as its second anchor has depth 1. Widths hold for the uncapped
    schedule.
    """
    role = F.when(F.col("thread") < F.col("n_warm"), 0).when(F.col("thread") < F.col("n_warm") + F.col("n_middle"), 1).otherwise(2)
    anchor = F.col("target").isin(ids.bos, ids.sot, ids.eot, ids.sot_tail).cast("int")
    out = pos.withColumn("line_role", role).withColumn("is_anchor_target", anchor)
    nxt = F.lead("local_step").over(Window.partitionBy(key, "thread").orderBy("local_step"))
    first = F.when(role == 2, 2).otherwise(1)
    out = out.withColumn("__next", nxt).withColumn("depth_in_line", F.when(F.col("__next").isNull(), -1).otherwise(depth_bucket(F.col("__next"))))
    out = out.withColumn("line_start", F.coalesce(((F.col("is_anchor_target") == 0) & (F.col("__next") == first)).cast("int"), F.lit(0))).drop("__next")
    width = F.count(F.when(role == 1, 1)).over(Window.partitionBy(key, "phase", "step"))
    return out.withColumn("wave_width", F.when(role == 1, width.cast("int")).otherwise(1))


def position_labels(pos: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add source_index and target_row: the place in source order and the row position of the predicted content token, else -1."""
    content = (F.col("local_step") >= F.when(F.col("has_tail") & (F.col("thread") == F.col("n_warm") + F.col("n_middle")), 2).otherwise(1))
    order = Window.partitionBy(key).orderBy("thread", "local_step")
    own = pos.withColumn("__c", content).withColumn("__i", F.sum(F.col("__c").cast("int")).over(order) - 1)
    nxt = Window.partitionBy(key, "thread").orderBy("local_step")
    is_next = F.coalesce(F.lead("__c").over(nxt), F.lit(False))
    out = own.withColumn("source_index", F.when(is_next, F.lead("__i").over(nxt)).otherwise(-1).cast("int")).withColumn("target_row", F.when(is_next, F.lead("row_pos").over(nxt)).otherwise(-1))
    return out.drop("__c", "__i")


def plain_slice_labels(stream: DataFrame, key: str, bos: int) -> DataFrame:
    """Add depth_in_line, line_start, is_anchor_target to a plain stream (key, pos, token, target, target_bytes, is_newline).

    Depth counts from the last break (``bos`` or a newline token); a negative target is no target, a target of no bytes
    an anchor.
    """
    brk = (F.col("token") == bos) | F.col("is_newline")
    last = F.max(F.when(brk, F.col("pos"))).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    valid = F.col("target") >= 0
    content = valid & (F.col("target_bytes") > 0)
    depth = F.when(content, depth_bucket(F.col("pos") - F.coalesce(last, F.lit(-1)) + 1)).otherwise(-1)
    return stream.withColumn("depth_in_line", depth).withColumn("line_start", (brk & content).cast("int")).withColumn("is_anchor_target", (valid & (F.col("target_bytes") == 0)).cast("int"))


def carry_wave(stream: DataFrame, key: str, bos: int, wave_of: Column) -> DataFrame:
    """Add wave: 1 from a ``bos`` on, k from a wave opener (``wave_of`` gives its k, null elsewhere) on; 1 before any."""
    mark = F.when(F.col("token") == bos, 1).otherwise(wave_of)
    return stream.withColumn("wave", F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)))
