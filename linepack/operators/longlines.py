"""Splitting of over-long lines at sentence ends near their middle.

The recursion runs where the text is, one Arrow batch of texts at a time: no shuffle, no key, and all other columns stay
in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cap_newline_runs, strip_leading_newlines

#: The tokens a line may have, the punctuation a line may be cut after, and the share of it searched.
MOST = 254
STOPS = ".!?;。！？；…"
WINDOW = 0.25
_SEGMENT = re.compile(r"([^\n\r]+)([\n\r]*)|[\n\r]+")

Measure = Callable[[Column], Column]


def n_words(col: Column) -> Column:
    """A measure that needs no vocabulary: words between blanks."""
    return F.size(F.split(col, " "))


def split_segments(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows (..., seg, content, sep): contents and the newline runs after them, in order; together they are the text."""
    pairs = F.regexp_extract_all(F.col(col), F.lit(r"[^\n\r]+[\n\r]*|[\n\r]+"), F.lit(0))
    rows = df.select(*[c for c in df.columns if c != col], F.posexplode(pairs).alias("seg", "__s"))
    return rows.withColumn("content", F.regexp_replace("__s", r"[\n\r]+$", "")).withColumn("sep", F.regexp_extract("__s", r"[\n\r]+$", 0)).drop("__s")


def over_budget(content: Column, sep: Column, most: int, measure: Measure) -> Column:
    """Whether a line and its newlines have too many tokens. A token has a byte at least, so short lines need no count."""
    return F.when(F.octet_length(content) + F.octet_length(sep) <= most, False).otherwise(measure(content) + F.length(sep) > most)


def count_words(text: str) -> int:
    """``n_words`` for text at hand."""
    return text.count(" ") + 1


def _cut(text: str) -> int:
    """Where to cut a piece: after the last stop within a quarter of its middle, else in the middle."""
    n = len(text)
    mid, half = n // 2, max(1, int(n * WINDOW))
    low, high = max(0, mid - half), min(n, mid + half)
    at = max(text.rfind(stop, low, high) for stop in STOPS) + 1
    return at if 0 < at < n else mid


def cut_line(line: str, room: int, most: int, count: Callable[[str], int]) -> list[str]:
    """The pieces of a line that fit: each leaves room for one newline, the last one for ``room`` of them."""
    out, todo = [], [(line, room)]
    while todo:
        text, budget = todo.pop()
        if len(text) < 2 or len(text.encode("utf-8", "replace")) + budget <= most or count(text) + budget <= most:
            out.append(text)
        else:
            at = _cut(text)
            todo += [(text[at:], budget), (text[:at], 1)]
    return out


def split_long_lines(df: DataFrame, most: int = MOST, count: Callable[[str], int] = count_words, run: int = 16, col: str = "text") -> DataFrame:
    """``col`` with leading newlines stripped, newline runs capped at ``run`` and every over-long line cut into lines that fit.

    Cuts add one newline each and change nothing else. A left piece leaves room for its newline, the last piece for the
    line's own separator. A line has as many tokens as ``count`` says and at most one a byte. Null texts stay null.
    """
    def line(m: re.Match) -> str:
        content, sep = m.group(1) or "", m.group(2) or ""
        if not content or len(content.encode("utf-8", "replace")) + len(sep) <= most or count(content) + len(sep) <= most:
            return m.group()
        return "\n".join(cut_line(content, max(1, len(sep)), most, count)) + sep

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or len(t) * 4 <= most else _SEGMENT.sub(line, t))

    return df.withColumn(col, cut(cap_newline_runs(strip_leading_newlines(F.col(col)), run)))


def rejoin(lines: DataFrame, key: str, col: str) -> DataFrame:
    """(key, text) from (key, seg, line, sep): lines and separators in order."""
    parts = F.array_sort(F.collect_list(F.struct("seg", F.concat("line", "sep").alias("t"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(col))
