"""Text columns: newline runs, one-line collapse, prompt rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cap_newline_runs(col: Column, most: int = 16) -> Column:
    """Runs of newlines and carriage returns are cut to ``most``; 0 turns the cap off."""
    return F.regexp_replace(col, rf"([\n\r]{{{most}}})[\n\r]+", "$1") if most else col


def strip_leading_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"^[\n\r]+", "")


def blocks(col: Column) -> Column:
    """A text's blocks: content with the newline run after it; together they are the text."""
    return F.split(col, r"(?<=[\n\r])(?=[^\n\r])")


def one_line(*cols: Column) -> Column:
    """Each part with its line breaks as one blank, trimmed; parts that are not empty joined by a blank."""
    flat = [F.nullif(F.trim(F.regexp_replace(c, r"[ \t]*\r?\n[ \t]*", " ")), F.lit("")) for c in cols]
    return F.concat_ws(" ", *flat)


def final_question(col: Column, question: str = "Question: ", answer: str = "Answer:") -> Column:
    """The last question, between its mark and the answer mark."""
    return F.regexp_replace(F.substring_index(F.substring_index(col, question, -1), answer, 1), r"(?U)^\s+|\s+$", "")


def count_turns(col: Column, question: str = "Question: ") -> Column:
    """History turns: questions before the last one."""
    return F.greatest(F.size(F.split(col, question)) - 2, F.lit(0))


def _last_pair(col: Column, question: str, answer: str) -> tuple[Column, Column, Column]:
    """The text up to and with the last ``question``, what follows up to ``answer``, and what comes after that; the first
    is null where one of them is missing."""
    last = F.substring_index(col, question, -1)
    line = F.substring_index(last, answer, 1)
    found = col.contains(question) & last.contains(answer)
    asked = F.when(found, F.substring(col, F.lit(1), F.length(col) - F.length(last)))
    return asked, line, F.substring(last, F.length(line) + len(answer) + 1, F.length(last))


def final_pair_on_one_line(col: Column) -> Column:
    """The last question and answer mark of a passage prompt on one line."""
    asked, line, after = _last_pair(col, "\nQuestion: ", "\nAnswer:")
    good = ~line.contains("\n") & after.rlike(r"^\s*$")
    return F.when(asked.isNotNull() & good, F.concat(asked, line, F.lit(" Answer:"))).otherwise(col)


#: Marks and sentences of the story prompts.
PRECEDING, FINAL = "Preceding questions:\n", "\nFinal question:\n"
STORY = "Below is a story followed by a series of related questions. Please answer the final question by referring to the story and the previous questions."
STORY_ALONE = "Below is a story followed by a question. Please answer the question by referring to the story."


def joined_history(col: Column) -> Column:
    """Each preceding question and its answer on one line; the final question, its heading and the answer mark on one line."""
    at = F.instr(col, PRECEDING)
    end = F.instr(F.substring(col, at + len(PRECEDING), F.length(col)), "\n" + FINAL) + at + len(PRECEDING) - 1
    lines = F.split(F.substring(col, at, end - at + 1), "\n", -1)
    last = F.size(lines) - 1

    def step(acc: Column, x: Column) -> Column:  # an answer line goes to the question line before it, once
        joined = acc["asked"] & x.startswith("Answer: ") & (acc["i"] < last)
        text = F.concat(acc["s"], F.when(joined, " ").otherwise("\n"), x)
        return F.struct(text.alias("s"), (~joined & x.contains("Question: ")).alias("asked"), (acc["i"] + 1).alias("i"))

    head = F.get(lines, F.lit(0))
    inside = F.aggregate(F.slice(lines, F.lit(2), F.greatest(last, F.lit(0))), F.struct(head.alias("s"), head.contains("Question: ").alias("asked"), F.lit(1).alias("i")), step, lambda acc: acc["s"])
    rebuilt = F.concat(F.substring(col, F.lit(1), at - 1), inside, F.substring(col, end + 1, F.length(col)))
    found = (at > 0) & (end > at + len(PRECEDING) - 1)
    out = F.when(found, rebuilt).otherwise(col)
    asked, line, after = _last_pair(out, FINAL + "Question: ", "\nAnswer: ")
    head = F.substring(asked, F.lit(1), F.length(asked) - len(FINAL + "Question: "))
    return F.when(asked.isNotNull() & ~line.contains("\n") & (after == ""), F.concat(head, F.lit("\nFinal question: Question: "), line, F.lit(" Answer: "))).otherwise(out)


def without_history(col: Column) -> Column:
    """The history block dropped, the sentence before the story swapped, and no heading before the question."""
    at = F.instr(col, "\n" + PRECEDING)
    rest = F.substring(col, at + len("\n" + PRECEDING), F.length(col))
    to = F.instr(rest, FINAL)
    cut = F.when((at > 0) & (to > 0), F.concat(F.substring(col, F.lit(1), at - 1), F.substring(rest, to, F.length(rest)))).otherwise(col)
    cut = F.replace(cut, F.lit(STORY), F.lit(STORY_ALONE))
    return F.replace(cut, F.lit(FINAL + "Question: "), F.lit("\nQuestion: "))


def is_answer_block(col: Column) -> Column:
    """A block that starts with four hashes after any white space."""
    return F.regexp_replace(col, r"(?U)^\s+", "").startswith("####")


def token_id(col: Column) -> Column:
    """A token's id where no vocabulary is learned: the first 28 bits of its MD5; needs no pass over the corpus."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 7), 16, 10).cast("int")


def word_blocks(col: Column) -> Column:
    """Each block's words between blanks; the newline run stays on the last word of its block."""
    def of(block: Column) -> Column:
        run = F.regexp_extract(block, r"[\n\r]+$", 0)
        return F.split(F.concat(F.replace(F.regexp_replace(block, r"[\n\r]+$", ""), F.lit(" "), F.lit("\u0001")), run), "\u0001")

    return F.transform(blocks(col), of)
