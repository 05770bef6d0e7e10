"""Few-shot prompts: selection, rendering, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line


def fewshot(items: DataFrame, task: str, item: str, k: int, seed: int = 1234, pool: str | None = None) -> DataFrame:
    """(task, item, j, shot): ``k`` other items of the task for each item, without repeats; none where the pool is too small.

    The pool is all items of the task, or those where the boolean column ``pool`` is true; items outside it get shots too. The
    pool is numbered within its task; an item takes the numbers of a walk a j + b modulo the number of others, with a prime
    to it, both drawn by hash, and skips itself if the pool holds it. Then it is one join on the number, never all pairs.
    """
    inside = F.coalesce(F.col(pool), F.lit(False)) if pool else F.lit(True)
    every = items.select(task, item, inside.alias("__in"))
    numbered = every.withColumn("__r", F.count_if("__in").over(Window.partitionBy(task).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)) - 1)
    size = numbered.groupBy(task).agg(F.count_if("__in").alias("__p"))
    drawn = numbered.join(size, task).withColumn("__m", F.col("__p") - F.col("__in").cast("int")).where((F.col("__m") >= k) & (F.col("__m") > 0))
    def h(salt: str) -> Column:  # 60 bits of a digest, so that any engine draws the same
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col(item).cast("string")).cast("binary"))
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.col("__m"))

    drawn = drawn.withColumn("__b", h("b"))
    # the first of a run of steps that has no divisor with the pool's size; 1 always has none
    gcd = lambda a: F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.alias("x"), F.col("__m").alias("y")), lambda t, _: F.struct(F.when(t["x"] == 0, F.lit(0).cast("bigint")).otherwise(F.pmod(t["y"], t["x"])).alias("x"), F.when(t["x"] == 0, t["y"]).otherwise(t["x"]).alias("y")), lambda t: t["y"])
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(h("a") + i, F.col("__m")))
    drawn = drawn.withColumn("__a", F.coalesce(F.get(F.filter(steps, lambda a: (a > 0) & (gcd(a) == 1)), F.lit(0)), F.lit(1)))
    each = drawn.select(task, item, "__r", "__in", "__m", "__a", "__b", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    other = F.pmod(F.col("__a") * F.col("j") + F.col("__b"), F.col("__m"))
    each = each.select(task, item, "j", (other + F.when(F.col("__in") & (other >= F.col("__r")), 1).otherwise(0)).alias("__other"))
    members = numbered.where("__in").select(task, F.col("__r").alias("__other"), F.col(item).alias("shot"))
    return each.join(members, [task, "__other"]).select(task, item, "j", "shot")


def gather_shots(picked: DataFrame, items: DataFrame, task: str, item: str, fields: list[str]) -> DataFrame:
    """(task, item, shots): the fields of the chosen items in order."""
    body = items.select(task, F.col(item).alias("shot"), *fields)
    one = F.struct("j", *fields)
    return picked.join(body, [task, "shot"]).groupBy(task, item).agg(F.array_sort(F.collect_list(one)).alias("shots"))


def _prefix(shots: Column, render, layout: str) -> Column:
    """The shots' texts before the item: a line each in the one-line layout, else with a blank line between."""
    texts = F.transform(F.coalesce(shots, F.array()), render)
    gap = "\n" if layout == "one_line" else "\n\n"
    return F.when(F.size(texts) > 0, F.concat(F.array_join(texts, gap), F.lit(gap))).otherwise("")


def _join(layout: str, *parts: Column) -> Column:
    return one_line(*parts) if layout == "one_line" else F.concat(*parts)


def render_choices(query: Column, choices: Column, shots: Column | None, delimiter: str, layout: str = "normal") -> Column:
    """A prompt for each choice; shots are structs of query and answer."""
    d = F.lit(delimiter)
    before = F.lit("") if shots is None else _prefix(shots, lambda s: _join(layout, s["query"], d, s["answer"]), layout)
    return F.transform(choices, lambda c: F.concat(before, _join(layout, query, d, c)))


def render_schema(options: Column, continuation: Column, shots: Column | None, delimiter: str, layout: str = "normal") -> Column:
    """A prompt for each context; the continuation is fixed. Shots are structs of query (their right context) and answer."""
    d = F.lit(delimiter)
    before = F.lit("") if shots is None else _prefix(shots, lambda s: _join(layout, s["query"], d, s["answer"]), layout)
    return F.transform(options, lambda o: F.concat(before, _join(layout, o, d, continuation)))


def render_lm(context: Column, continuation: Column, shots: Column | None, delimiter: str, layout: str = "normal") -> Column:
    """The prompt without and with its continuation; contexts are trimmed and the first is stripped."""
    d, strip = F.lit(delimiter), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    before = F.lit("") if shots is None else _prefix(shots, lambda s: _join(layout, strip(s["query"]), d, s["answer"]), layout)
    if layout == "one_line":
        return F.array(F.concat(before, one_line(context, d)), F.concat(before, one_line(context, d, continuation)))
    head = F.concat(before, strip(context), d)
    return F.array(strip(head), F.concat(head, continuation))


def common_prefix(seqs: Column) -> Column:
    """Length of the common prefix of an array of token arrays."""
    least = F.array_min(F.transform(seqs, lambda s: F.size(s)))
    first = F.get(seqs, F.lit(0))
    # the fold stops counting at the first position where some sequence differs
    same = lambda i: F.forall(seqs, lambda s: F.get(s, i) == F.get(first, i))
    steps = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i) & same(i), n + 1).otherwise(n))


def common_suffix(seqs: Column) -> Column:
    return common_prefix(F.transform(seqs, lambda s: F.reverse(s)))


def spans(kind: str, seqs: Column) -> Column:
    """(start, end) of each sequence's candidate: after the common prefix, the common suffix, or the first sequence's length."""
    if kind == "multiple_choice":
        return F.transform(seqs, lambda s: F.struct(common_prefix(seqs).alias("start"), F.size(s).alias("end")))
    if kind == "schema":
        return F.transform(seqs, lambda s: F.struct((F.size(s) - common_suffix(seqs)).alias("start"), F.size(s).alias("end")))
    return F.transform(seqs, lambda s: F.struct(F.size(F.get(seqs, F.lit(0))).alias("start"), F.size(s).alias("end")))


def truncate_left(ids: Column, start: Column, end: Column, most: int) -> tuple[Column, Column, Column]:
    """The last ``most`` ids and the span moved with them; a span cut by that is an error."""
    cut = F.greatest(F.size(ids) - most, F.lit(0))
    new = F.when(start - cut < 0, F.raise_error(F.lit("a span starts before the kept ids"))).otherwise(start - cut)
    return F.slice(ids, cut + 1, F.lit(most)), new.cast("int"), end - cut


def pad_to_longest(ids: Column, longest: Column, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), longest - F.size(ids)))


def layout_spans(pos: DataFrame, n: DataFrame, key: str) -> DataFrame:
    """(key, start, end) in the re-ordered row of the last n content positions in block order (``n``: key, n; less than
    one counts as one); keys whose candidate leaves the last block are left out."""
    last = F.col("thread") == F.col("n_warm") + F.col("n_middle") + F.col("has_tail").cast("int") - 1
    tail = F.col("has_tail") & last
    content = pos.where(F.col("local_step") >= F.when(tail, 2).otherwise(1)).withColumn("__last", last)
    back = Window.partitionBy(key).orderBy(F.desc("thread"), F.desc("local_step"))
    chosen = content.withColumn("__k", F.row_number().over(back)).join(n.select(key, F.greatest("n", F.lit(1)).alias("n")), key).where("__k <= n")
    out = chosen.groupBy(key).agg(F.min("row_pos").alias("start"), (F.max("row_pos") + 1).alias("end"), F.bool_and("__last").alias("inside"))
    return out.where("inside").drop("inside")


def filter_multiline(items: DataFrame, candidates: str) -> tuple[DataFrame, DataFrame]:
    """(kept items, dropped count): items without a line break in any candidate."""
    has = F.exists(F.col(candidates), lambda c: c.contains("\n"))
    return items.where(~has), items.agg(F.count_if(has).alias("dropped"))
