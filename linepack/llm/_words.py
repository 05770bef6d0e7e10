"""Words of whole batches of texts, cut at byte classes by array operations; no word becomes a Python object."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_class(gaps: list[tuple[int, int]]) -> np.ndarray:
    """For each byte, A-Z taken as a-z, 0 where it lies in one of ``gaps`` (inclusive), else itself.

    Classes of ASCII gaps: every byte of a character beyond ASCII belongs to words, so bytes may stand for characters.
    """
    low = np.frombuffer(bytes(range(256)).lower(), np.uint8).copy()
    for a, b in gaps:
        low[(low >= a) & (low <= b)] = 0
    low[0] = 0
    return low


def in_pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` have at most ``most`` bytes together, or a single row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def words_of(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order (binary) and their number in each; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    low = kinds[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None and data.size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = low != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]  # a text that begins with a word opens one, whatever stands before it
    opens[first] |= inside[first]
    starts = np.flatnonzero(opens)
    body = low[inside]
    bounds = np.append((np.cumsum(inside) - 1)[starts], len(body)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return words, np.diff(np.searchsorted(starts, ends))
