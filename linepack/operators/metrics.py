"""Evaluation analytics over tables of losses and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def _measures(nats: Column, size: Column, empty: float) -> list[Column]:
    """Bits per byte, cross-entropy a token, tokens and bytes over the targets that have bytes."""
    on = size > 0
    total, n, b = F.sum(F.when(on, nats)), F.count_if(on), F.coalesce(F.sum(F.when(on, size)), F.lit(0)).cast("bigint")
    return [F.coalesce(total / (LN2 * b), F.lit(empty)).alias("bpb"), F.coalesce(total / n, F.lit(empty)).alias("ce_per_token"), n.alias("n_tokens"), b.alias("total_bytes")]


def with_bytes(losses: DataFrame, sizes: DataFrame) -> DataFrame:
    """Join (target) to its byte length (id, n_bytes); specials, negative and unknown targets have none."""
    return losses.join(sizes.select(F.col("id").alias("target"), F.col("n_bytes").alias("target_bytes")), "target", "left").withColumn("target_bytes", F.coalesce("target_bytes", F.lit(0)))


def bpb(losses: DataFrame, *groups: str) -> DataFrame:
    """(groups, bpb, ce_per_token, ce_all, n_tokens, total_bytes); infinite without bytes."""
    everything = F.avg(F.when(F.col("target") >= 0, F.col("nats"))).alias("ce_all")
    return losses.groupBy(*groups).agg(*_measures(F.col("nats"), F.col("target_bytes"), float("inf")), everything)


def bpb_sliced(losses: DataFrame, slices: dict[str, int]) -> DataFrame:
    """(slice, label, bpb, ce_per_token, n_tokens, total_bytes) for label columns; ``slices`` gives their number of labels.

    Negative labels do not apply and labels beyond the number are dropped.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), F.col(k).cast("int").alias("label"), F.lit(n).alias("n")) for k, n in slices.items()]))
    rows = losses.where(F.col("target_bytes") > 0).select("nats", "target_bytes", pairs.alias("x")).where("x.label >= 0 and x.label < x.n")
    return rows.groupBy("x.slice", "x.label").agg(*_measures(F.col("nats"), F.col("target_bytes"), float("nan")))


def bpb_per_k(losses: DataFrame, k: str) -> DataFrame:
    """As ``bpb`` for each value of ``k``, with the total as k = 0, and perplexity."""
    rows = losses.where(F.col("target_bytes") > 0).rollup(k).agg(F.grouping(k).alias("__all"), *_measures(F.col("nats"), F.col("target_bytes"), float("nan")))
    return rows.withColumn(k, F.when(F.col("__all") == 1, 0).otherwise(F.col(k))).drop("__all").withColumn("ppl", F.exp("ce_per_token"))


def slice_breakdown(sliced: DataFrame, total: DataFrame) -> DataFrame:
    """(part, bpb, ppl, n_tokens): first token of a line, the boundary, the rest, and all."""
    name = F.when((F.col("slice") == "line_start") & (F.col("label") == 1), "first_line_token").when((F.col("slice") == "depth_in_line") & (F.col("label") == 0), "line_boundary").when((F.col("slice") == "line_start") & (F.col("label") == 0), "rest_of_line")
    parts = sliced.withColumn("part", name).where("part is not null").select("part", "bpb", F.exp("ce_per_token").alias("ppl"), "n_tokens")
    return parts.unionByName(total.select(F.lit("aggregate").alias("part"), "bpb", F.exp("ce_per_token").alias("ppl"), "n_tokens"))


def position_curve(losses: DataFrame, pos: str) -> DataFrame:
    """(pos, nats, n_tokens, total_bytes) for every position up to the last; positions without a loss are empty."""
    got = losses.where((F.col("target_bytes") > 0) & (F.col(pos) >= 0)).groupBy(F.col(pos).cast("int").alias("pos")).agg(F.sum("nats").alias("nats"), F.count("*").alias("n_tokens"), F.sum("target_bytes").cast("bigint").alias("total_bytes"))
    every = got.agg(F.max("pos").alias("m")).select(F.explode(F.sequence(F.lit(0), "m")).alias("pos"))
    return every.join(got, "pos", "left").fillna(0, ["n_tokens", "total_bytes"]).fillna(0.0, ["nats"])


def position_curves(losses: DataFrame, places: dict[str, str]) -> DataFrame:
    """(curve, pos, nats, n_tokens, total_bytes): ``position_curve`` of the same losses by several place columns, in one pass.

    ``places`` gives each curve's column. A loss without a place (negative or null) in one of them is in none, so all curves
    have equal totals.
    """
    placed = losses.where(F.col("target_bytes") > 0)
    for column in places.values():
        placed = placed.where(F.col(column) >= 0)
    each = placed.select("nats", "target_bytes", F.explode(F.array(*[F.struct(F.lit(k).alias("curve"), F.col(c).cast("int").alias("pos")) for k, c in places.items()])).alias("x"))
    got = each.groupBy("x.curve", "x.pos").agg(F.sum("nats").alias("nats"), F.count("*").alias("n_tokens"), F.sum("target_bytes").cast("bigint").alias("total_bytes"))
    every = got.groupBy("curve").agg(F.max("pos").alias("m")).select("curve", F.explode(F.sequence(F.lit(0), "m")).alias("pos"))
    return every.join(got, ["curve", "pos"], "left").fillna(0, ["n_tokens", "total_bytes"]).fillna(0.0, ["nats"])


def smooth_curve(curve: DataFrame, half: int, *groups: str) -> DataFrame:
    """(groups, pos, bpb, ce, ppl) over positions within ``half`` of each; null where there is nothing.

    A curve has one row a position, so a window holds positions, not documents.
    """
    w = Window.partitionBy(*groups).orderBy("pos").rangeBetween(-half, half)
    s = lambda c: F.sum(c).over(w)
    ce = F.try_divide(s("nats"), s("n_tokens"))
    return curve.select(*groups, "pos", F.try_divide(s("nats"), LN2 * s("total_bytes")).alias("bpb"), ce.alias("ce"), F.exp(ce).alias("ppl"))


def curve_points(raw: DataFrame, smooth: DataFrame, low: int, high: int) -> DataFrame:
    own = raw.select("pos", F.try_divide("nats", LN2 * F.col("total_bytes")).alias("raw_bpb"), "n_tokens")
    return own.join(smooth, "pos").where(F.col("pos").between(low, high))


def curve_summary(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum("nats") / (LN2 * F.sum("total_bytes"))).alias("bpb"), (F.sum("nats") / F.sum("n_tokens")).alias("ce_per_token"), F.sum("n_tokens").alias("n_tokens"), F.sum("total_bytes").alias("total_bytes"), (F.max("pos") + 1).alias("positions"))


def score_choices(spans: DataFrame, losses: DataFrame) -> DataFrame:
    """(item, choice): the candidate with the lowest mean loss over positions start - 1 to end - 2, the first on ties.

    ``spans``: (item, choice, start, end); ``losses``: (item, choice, pos, nats). Equality on both keys, the span is a filter.
    """
    met = spans.join(losses, ["item", "choice"]).where((F.col("pos") >= F.col("start") - 1) & (F.col("pos") <= F.col("end") - 2))
    means = met.groupBy("item", "choice").agg(F.avg("nats").alias("loss"))
    return means.groupBy("item").agg(F.min_by("choice", F.struct("loss", "choice")).alias("choice"))


def score_exact(spans: DataFrame, predictions: DataFrame) -> DataFrame:
    """(item, correct): all tokens of the span predicted; ``predictions``: (item, pos, predicted, actual of the next position)."""
    met = spans.join(predictions, "item").where((F.col("pos") >= F.col("start") - 1) & (F.col("pos") <= F.col("end") - 2))
    return met.groupBy("item").agg(F.bool_and(F.col("predicted") == F.col("actual")).alias("correct"))


def exact_match(start: Column, end: Column, predicted: Column, actual: Column) -> Column:
    """``score_exact`` of an item whose predictions are arrays by position: null where the span holds none that is known."""
    known = F.filter(F.slice(F.zip_with(predicted, actual, lambda p, a: p == a), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)), F.lit(0))), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.forall(known, lambda x: x))


def task_accuracy(scored: DataFrame, task: str = "task") -> DataFrame:
    """(task, accuracy, counted): over counted items (``correct`` not null); 0 for none."""
    return scored.groupBy(task).agg(F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy"), F.count("correct").alias("counted"))


def centred(accuracy: DataFrame, baselines: DataFrame, task: str = "task") -> DataFrame:
    """Add centered: accuracy above chance, chance in percent."""
    chance = 0.01 * F.col("random_baseline")
    return accuracy.join(baselines, task).withColumn("centered", (F.col("accuracy") - chance) / (1 - chance))


def core_metric(rows: DataFrame, expected: int) -> DataFrame:
    return rows.agg(F.avg("centered").alias("core"), F.count("*").alias("n_tasks"), (F.count("*") < expected).alias("partial"))


def format_ablation(rows: DataFrame) -> DataFrame:
    """(group, two_line, same_line, delta) from (group, layout, score)."""
    out = rows.groupBy("group").pivot("layout", ["two_line", "same_line"]).agg(F.first("score"))
    return out.withColumn("delta", F.col("same_line") - F.col("two_line"))


def compare_runs(fresh: DataFrame, ref: DataFrame, bpb_tol: float = 0.007, score_tol: float = 0.01) -> DataFrame:
    """(run, metric, ref, fresh, gap, flag): OK within the tolerance, GAP beyond it, ? where there is no fresh value."""
    met = ref.select("run", "metric", F.col("value").alias("ref")).join(fresh.select("run", "metric", F.col("value").alias("fresh")), ["run", "metric"], "left")
    gap = F.col("fresh") - F.col("ref")
    tol = F.when(F.col("metric") == "bpb", bpb_tol).otherwise(score_tol)
    return met.withColumn("gap", gap).withColumn("flag", F.when(gap.isNull(), "?").when(F.abs(gap) <= tol, "OK").otherwise("GAP"))


def overall(compared: DataFrame) -> DataFrame:
    """(compared, gaps, missing, flag) of all runs of ``compare_runs``: GAP if any has one, else ? if any is missing, else OK."""
    gaps, missing = F.count_if(F.col("flag") == "GAP"), F.count_if(F.col("flag") == "?")
    return compared.agg(F.count("*").alias("compared"), gaps.alias("gaps"), missing.alias("missing"), F.when(gaps > 0, "GAP").when(missing > 0, "?").otherwise("OK").alias("flag"))


def _in_answer(p: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Whether a position lies in the span [start, end), and whether it predicts one that does."""
    return p.between(start, end - 1), p.between(start - 1, end - 2)


def row_records(pos: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Add is_answer and predicts_answer for the span [start, end) of each row."""
    met = pos.join(spans.select(key, "start", "end"), key)
    own, before = _in_answer(F.col("row_pos"), F.col("start"), F.col("end"))
    return met.withColumn("is_answer", own).withColumn("predicts_answer", before).drop("start", "end")


def row_flags(row_pos: Column, start: Column, end: Column) -> list[Column]:
    """is_answer and predicts_answer of a row whose positions are an array: nothing is shuffled."""
    return [F.transform(row_pos, lambda p: _in_answer(p, start, end)[0]), F.transform(row_pos, lambda p: _in_answer(p, start, end)[1])]
