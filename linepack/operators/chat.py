"""Conversations: assembly, checks, rendering with a mask, turn documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Special tokens by name; ids are the caller's.
MARKS = ("bos", "user_start", "user_end", "assistant_start", "assistant_end", "python_start", "python_end", "output_start", "output_end")


def assemble(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): turns in order, each (turn, role, text); ties by role and text."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def merge_system(turns: DataFrame) -> DataFrame:
    """A leading system turn goes before the user turn after it, with a blank line between."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev = F.struct(F.lag("role").over(w).alias("role"), F.lag("text").over(w).alias("text"), F.row_number().over(w).alias("n"), F.lead("role").over(w).alias("next"))
    met = turns.withColumn("__p", prev)
    after = (F.col("__p.n") == 2) & (F.col("__p.role") == "system") & (F.col("role") == "user")
    gone = (F.col("__p.n") == 1) & (F.col("role") == "system") & (F.col("__p.next") == "user")
    text = F.when(after, F.concat(F.col("__p.text"), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    return met.where(~F.coalesce(gone, F.lit(False))).withColumn("text", F.when(F.coalesce(after, F.lit(False)), text).otherwise(F.col("text"))).drop("__p")


#: The part types of an assistant turn.
PART_TYPES = ("text", "python", "python_output")
_PARTS = "array<struct<type:string,text:string>>"


def read_content(turns: DataFrame, content: str = "content") -> DataFrame:
    """Add text, parts and kind from a variant ``content``: a string (kind ``text``), a list of {type, text} (``parts``), else ``other``.

    An element of a list that is no object, or has no text, keeps its place with nulls. A null content has a null kind.
    """
    c = F.col(content)
    of = F.schema_of_variant(c)
    listed = of.startswith("ARRAY<")
    out = turns.withColumn("kind", F.when(of == "STRING", "text").when(listed, "parts").when(of.isNotNull() & (of != "VOID"), "other"))
    out = out.withColumn("text", F.when(of == "STRING", F.try_variant_get(c, "$", "string")))
    each = F.when(listed, F.try_variant_get(c, "$", "array<variant>"))
    part = lambda v, path: F.try_variant_get(v, path, "string")
    return out.withColumn("parts", F.transform(each, lambda v: F.struct(part(v, "$.type").alias("type"), part(v, "$.text").alias("text"))).cast(_PARTS))


def validate(turns: DataFrame) -> DataFrame:
    """(conv_id, n, reason): null for a conversation that can be rendered; else the first thing wrong, by turn.

    Roles alternate from user on, after a leading system turn that ``merge_system`` has merged. A user turn is a text; an
    assistant turn is a text or, where the table has ``parts`` (``read_content``), a list whose parts have known types and
    texts. Anything else is named: ``no content``, ``content of another kind``, ``parts in a user turn``, ``unknown part
    type``, ``part without text``, ``roles do not alternate``. Turns that repeat a number are ordered by role and text.
    """
    parted = "parts" in turns.columns
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    want = F.when(n % 2 == 1, "user").otherwise("assistant")
    reason = F.when(~F.col("role").eqNullSafe(want), "roles do not alternate")
    if "kind" in turns.columns:
        reason = reason.when(F.col("kind") == "other", "content of another kind")
    if parted:
        has = lambda test: F.exists("parts", test)
        reason = reason.when(F.col("parts").isNotNull() & (F.col("role") == "user"), "parts in a user turn")
        reason = reason.when(has(lambda p: ~F.coalesce(p["type"].isin(*PART_TYPES), F.lit(False))), "unknown part type").when(has(lambda p: p["text"].isNull()), "part without text")
    reason = reason.when(F.col("text").isNull() & (F.col("parts").isNull() if parted else F.lit(True)), "no content")
    bad = turns.withColumn("__n", n).withColumn("__bad", reason)
    return bad.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("__bad", F.when(F.col("__bad").isNotNull(), F.col("__n"))).alias("reason"))


def quarantine(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the conversations that can be rendered, all turns of the others with the reason of their conversation)."""
    judged = validate(turns).select("conv_id", "reason")
    met = turns.join(judged, turns["conv_id"].eqNullSafe(judged["conv_id"])).drop(judged["conv_id"])
    return met.where("reason is null").drop("reason"), met.where("reason is not null")


def render(messages: Column, tokens, ids: dict[str, int], most: int | None = 2048, parts: bool = False) -> Column:
    """Array of (id, mask): user turns and marks that open have mask 0, assistant text and its end 1; cut to ``most``.

    With ``parts`` a message has an array ``parts`` of (type, text) besides its text; where it is not null it is an
    assistant turn's content. Code (``python``) is supervised with its marks, its output (``python_output``) is not. Another
    part type is an error, and so is a turn that is neither the user's nor the assistant's: ``quarantine`` takes such
    conversations out before, and nothing but what the assistant said is ever supervised.
    """
    one = lambda i, m: F.array(F.struct(F.lit(i).alias("id"), F.lit(m).alias("mask")))

    def turn(m: Column) -> Column:
        body = lambda k: F.transform(tokens(m["text"]), lambda t: F.struct(t.alias("id"), F.lit(k).alias("mask")))
        user = F.concat(one(ids["user_start"], 0), body(0), one(ids["user_end"], 0))
        said = body(1)
        if parts:
            said = F.coalesce(F.flatten(F.transform(m["parts"], part)), said)
        reply = F.concat(one(ids["assistant_start"], 0), said, one(ids["assistant_end"], 1))
        other = F.raise_error(F.concat(F.lit("a turn of another role: "), F.coalesce(m["role"], F.lit("null")))).cast("array<struct<id:int,mask:int>>")
        return F.when(m["role"] == "user", user).when(m["role"] == "assistant", reply).otherwise(other)

    def part(p: Column) -> Column:
        of = lambda k: F.transform(tokens(p["text"]), lambda t: F.struct(t.alias("id"), F.lit(k).alias("mask")))
        code = F.concat(one(ids["python_start"], 1), of(1), one(ids["python_end"], 1))
        output = F.concat(one(ids["output_start"], 0), of(0), one(ids["output_end"], 0))
        unknown = F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(p["type"], F.lit("null")))).cast("array<struct<id:int,mask:int>>")
        return F.when(p["type"] == "text", of(1)).when(p["type"] == "python", code).when(p["type"] == "python_output", output).otherwise(unknown)

    out = F.concat(one(ids["bos"], 0), F.flatten(F.transform(messages, turn)))
    return out if most is None else F.slice(out, 1, most)


def for_completion(messages: Column, tokens, ids: dict[str, int]) -> Column:
    """The ids without the last assistant turn, with the mark that opens the next."""
    kept = F.when(F.element_at(messages, -1)["role"] == "assistant", F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)
    return F.concat(F.transform(render(kept, tokens, ids, None), lambda x: x["id"]), F.array(F.lit(ids["assistant_start"])))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, pair, prompt, reply): each user turn with the assistant turn right after it; unpaired turns are left out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    met = turns.withColumn("__role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    met = met.where((F.col("role") == "user") & (F.col("__role") == "assistant"))
    return met.select("conv_id", (F.row_number().over(w) - 1).alias("pair"), F.col("text").alias("prompt"), "reply")


def unpaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reason): the turns that ``turn_pairs`` leaves out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    met = turns.withColumn("__next", F.lead("role").over(w)).withColumn("__last", F.lag("role").over(w))
    reason = F.when(F.col("role") == "user", F.when(~F.col("__next").eqNullSafe("assistant"), "no reply")).when(F.col("role") == "assistant", F.when(~F.col("__last").eqNullSafe("user"), "no prompt")).otherwise("another role")
    return met.withColumn("reason", reason).where("reason is not null").select("conv_id", "turn", "role", "reason")


def _ids_of(values: Column, mask: int) -> Column:
    return F.transform(values, lambda t: F.struct(t.alias("id"), F.lit(mask).alias("mask")))


def chat_blocks(reply: Column, tokens, ids: dict[str, int], newline: int) -> Column:
    """An assistant turn's blocks of (id, mask): a block ends at every newline token, also at each of a run.

    The mark that opens the turn has mask 0, its text, the newlines in it and the mark that ends it have 1. That mark is
    never a newline, so one with mask 0 is put after it and closes the last block. ``tokens`` gives a line's ids.
    """
    lines = F.split(reply, "\n", -1)
    one = lambda i, m: F.array(F.struct(F.lit(i).alias("id"), F.lit(m).alias("mask")))
    none = F.slice(one(newline, 1), 1, 0)

    def block(line: Column, i: Column) -> Column:
        opens = F.when(i == 0, one(ids["assistant_start"], 0)).otherwise(none)
        ends = F.when(i < F.size(lines) - 1, one(newline, 1)).otherwise(F.concat(one(ids["assistant_end"], 1), one(newline, 0)))
        return F.concat(opens, _ids_of(tokens(line), 1), ends)

    return F.transform(lines, block)


def turn_documents(pairs: DataFrame, tokens, ids: dict[str, int], newline: int) -> DataFrame:
    """Add blocks, mask (of the same shape) and lens: the prompt with its marks as one block of mask 0, then the reply's blocks.

    The roles of a turn document are those of any other: the prompt is the first block, so it is warm-up and its length
    counts first; the last block of the reply is the tail. A null prompt or reply counts as empty.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = lambda i: F.array(F.lit(i))
    prompt = _ids_of(F.concat(one(ids["user_start"]), tokens(empty("prompt")), one(ids["user_end"])), 0)
    out = pairs.withColumn("__b", F.concat(F.array(prompt), chat_blocks(empty("reply"), tokens, ids, newline)))
    part = lambda name: F.transform("__b", lambda b: F.transform(b, lambda x: x[name]))
    return out.withColumn("blocks", part("id")).withColumn("mask", part("mask")).withColumn("lens", F.transform("__b", lambda b: F.size(b))).drop("__b")


def _unsupervised() -> Column:
    return (F.col("local_step") >= 1) & (F.coalesce("mask", F.lit(0)) == 0)


def mask_targets(pos: DataFrame) -> DataFrame:
    """Set target to -1 where the token that predicts has mask 0 (``mask`` went through the layout with the tokens).

    Anchors keep their target; the tail's second anchor has no mask and so never one.
    """
    return pos.withColumn("target", F.when(_unsupervised(), -1).otherwise(F.col("target")))


def masked_rows(rows: DataFrame) -> DataFrame:
    """``mask_targets`` of the array grain."""
    each = F.arrays_zip("target", "local_step", "mask")
    return rows.withColumn("target", F.transform(each, lambda x: F.when((x["local_step"] >= 1) & (F.coalesce(x["mask"], F.lit(0)) == 0), -1).otherwise(x["target"])))


def forced_flags(pos: DataFrame) -> DataFrame:
    """Add forced: every anchor, and content with mask 0."""
    return pos.withColumn("forced", (F.col("local_step") == 0) | _unsupervised())


def consumption(df: DataFrame, ordinal: str, n: int, workers: int) -> DataFrame:
    """Add worker, epoch (from 1) and the share of the epoch read, for strided reads of ``n`` conversations."""
    i = F.col(ordinal)
    return df.withColumn("worker", (i % workers).cast("int")).withColumn("epoch", F.floor(i / n) + 1).withColumn("progress", (i % n + 1) / n)
