"""Words of texts as ids: blocks of words and plain token streams, made in Arrow batches of bounded size.

The rule is that of ``functions.text.word_blocks`` and ``token_id``: a block is a line with its newline run, its words stand
between blanks, and the run stays on the last word. The places of blanks and newlines are found in the bytes of many
texts at once, and a word's id is computed once a batch, so the cost is that of a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import depth_buckets

#: Bytes of text that a task splits at once, besides those of one text.
AT_ONCE = 4 << 20


@dataclass
class _Split:
    """Words of some texts in order: blocks of each text, words of each block, and the words."""

    blocks: np.ndarray
    lens: np.ndarray
    words: pa.Array

    def texts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(np.append(0, np.cumsum(self.lens))[np.append(0, np.cumsum(self.blocks))])


def split_words(texts: pa.Array) -> _Split:
    """Blocks and words of ``texts``, none of them null; an empty text is a block of one empty word."""
    texts = texts.cast(pa.binary())
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    blank = raw == 32
    line = (raw == 10) | (raw == 13)
    opens = np.flatnonzero(line[:-1] & ~line[1:]) + 1  # a block opens behind a newline run, but not where a text begins
    begins = np.zeros(len(raw) + 1, bool)
    begins[off] = True
    opens = opens[~begins[opens]]
    blanks = np.flatnonzero(blank)
    starts = np.sort(np.concatenate((off[:-1], blanks + 1, opens)), kind="stable")
    ends = np.append(starts - np.searchsorted(blanks, starts), len(raw) - len(blanks))  # with the blanks gone words follow each other
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[~blank])])
    text = np.searchsorted(off, opens, side="right") - 1
    inner = np.searchsorted(blanks, opens) + np.arange(1, len(opens) + 1) + text
    first = np.searchsorted(blanks, off[:-1]) + np.searchsorted(opens, off[:-1]) + np.arange(len(off) - 1)
    block = np.sort(np.concatenate((first, inner)), kind="stable")
    return _Split(1 + np.bincount(text, minlength=len(off) - 1), np.diff(np.append(block, len(starts))), words)


def word_ids(words: pa.Array) -> np.ndarray:
    """``functions.text.token_id`` of each word: distinct ones are hashed."""
    coded = words.dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.int32)
    _, at, data = coded.dictionary.buffers()
    raw, ends = data.to_pybytes(), np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].tolist()
    digests = b"".join([md5(raw[a:b]).digest() for a, b in zip(ends, ends[1:])])  # noqa: B905
    return (np.frombuffer(digests, ">u4")[::4] >> 4).astype(np.int32)[coded.indices.to_numpy(zero_copy_only=False)]


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have ``AT_ONCE`` bytes at most, or that are one row."""
    size = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, AT_ONCE + (size[at - 1] if at else 0), side="right")))
        yield batch.slice(at, end - at)
        at = end


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def word_lists(df: DataFrame, *keys: str, text: str = "text", ids: bool = False) -> DataFrame:
    """(keys, [blocks,] lens): each text's blocks of word ids, and their numbers of words. Rows of null texts are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*keys, *(["blocks"] if ids else []), "lens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch, len(keys)):
                w = split_words(some.column(len(keys)))
                made = [some.column(k) for k in range(len(keys))]
                if ids:
                    made.append(_lists(w.blocks, _lists(w.lens, pa.array(word_ids(w.words)))))
                yield pa.RecordBatch.from_arrays([*made, _lists(w.blocks, pa.array(w.lens.astype(np.int32)))], names=names)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(["blocks array<array<int>>"] if ids else []), "lens array<int>"])
    return df.where(F.col(text).isNotNull()).select(*keys, text).mapInArrow(run, schema)


#: Columns of a stream, and their types.
COLUMNS = {"pos": "int", "token": "int", "target": "int", "target_bytes": "int", "is_newline": "boolean", "line_at": "int", "depth_in_line": "int", "line_start": "int", "is_anchor_target": "int", "wave": "int"}


def _stream(w: _Split, bos: int, openers: dict[int, int], columns: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray | pa.Array]]:
    """Positions of each text, and the columns of all positions."""
    size = w.texts()
    token, n_bytes = word_ids(w.words), np.diff(np.frombuffer(w.words.buffers()[1], np.int32)[: len(w.words) + 1])
    raw = np.frombuffer(w.words.buffers()[2], np.uint8)
    ends = np.frombuffer(w.words.buffers()[1], np.int32)[1 : len(w.words) + 1]
    last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(len(token), np.uint8)
    newline = (n_bytes > 0) & ((last == 10) | (last == 13))
    inside = np.arange(len(token)) - np.repeat(np.cumsum(w.lens) - w.lens, w.lens)
    if openers:  # one more token before each block
        of = {width: i for i, width in openers.items()}
        where = np.cumsum(w.lens) - w.lens
        token = np.insert(token, where, np.array([of[k] for k in range(1, len(of) + 1)], np.int32)[np.minimum(w.lens, len(of)) - 1])
        n_bytes, newline, inside = np.insert(n_bytes, where, 0), np.insert(newline, where, False), np.insert(inside, where, 0)
        size = size + w.blocks
    rows = size + 1
    row = np.arange(len(token)) + np.repeat(np.arange(len(size)), size)  # of the position that predicts a token
    first = np.cumsum(rows) - rows
    total = int(rows.sum())
    out: dict[str, np.ndarray | pa.Array] = {}

    def placed(values: np.ndarray, fill: int, shift: int = 0) -> np.ndarray:
        x = np.full(total, fill, values.dtype)
        x[row + shift] = values
        return x

    out["target"], out["target_bytes"] = placed(token, bos), placed(n_bytes, 0)
    out["token"], out["is_newline"] = placed(token, bos, 1), placed(newline, False, 1)
    out["pos"] = np.arange(total) - np.repeat(first, rows)
    if "line_at" in columns:
        end = np.ones(total, bool)
        end[row] = False
        out["line_at"] = pa.array(placed(inside, 0).astype(np.int32), mask=end)
    if {"depth_in_line", "line_start", "is_anchor_target"} & {*columns}:
        brk = (out["token"] == bos) | out["is_newline"]
        content = (out["target"] >= 0) & (out["target_bytes"] > 0)
        at = np.arange(total)
        depth = at - np.maximum.accumulate(np.where(brk, at, 0)) + 1  # each text begins with a break
        out["depth_in_line"], out["line_start"] = np.where(content, depth_buckets(depth), -1), brk & content
        out["is_anchor_target"] = (out["target"] >= 0) & (out["target_bytes"] == 0)
    if "wave" in columns:
        widths = {**openers, bos: 1}
        keys = np.array(sorted(widths), np.int64)
        near = np.minimum(np.searchsorted(keys, out["token"]), len(keys) - 1)
        mark = keys[near] == out["token"]
        carried = np.maximum.accumulate(np.where(mark, np.arange(total), 0))  # each text begins with a mark
        out["wave"] = np.array([widths[int(k)] for k in keys])[near][carried]
    return rows, out


def word_stream(df: DataFrame, key: str, *columns: str, text: str = "text", bos: int = 1, openers: dict[int, int] | None = None, arrays: bool = False) -> DataFrame:
    """(key, columns) of plain streams: ``bos`` and the words of each text, each predicting the next; the last predicts ``bos``.

    ``target_bytes`` has the target's bytes, 0 for a special; ``is_newline`` tells that the token ends its line, and ``line_at``
    is the target's place in its line, null for the last. ``openers`` puts one more token before each block: id and width K for
    widths from 1 on, by the block's words, the widest for all above. ``depth_in_line``, ``line_start`` and ``is_anchor_target``
    are those of ``layout.plain_slice_labels``, ``wave`` that of ``layout.carry_wave``; here they cost no window.
    With ``arrays`` a text is one row of arrays. Rows of null texts are left out.
    """
    if unknown := {*columns} - {*COLUMNS}:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}[key]
    types = {"int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _parts(batch, 1):
                rows, cols = _stream(split_words(some.column(1)), bos, openers or {}, columns)
                made = [pa.array(cols[c]).cast(types[COLUMNS[c]], safe=False) for c in columns]
                if arrays:
                    made = [some.column(0), *(_lists(rows, x) for x in made)]
                else:
                    made = [some.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows))), *made]
                yield pa.RecordBatch.from_arrays(made, names=[key, *columns])

    schema = ", ".join([f"`{key}` {kind}", *(f"{c} array<{COLUMNS[c]}>" if arrays else f"{c} {COLUMNS[c]}" for c in columns)])
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)
