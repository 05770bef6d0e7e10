"""Alignment of two tokenizers: where their tokens end together, and which of them do so most.

Both encodings of a text cover the same bytes, so each is an increasing list of end offsets. The shorter list drives: its
entries are searched in the longer one by doubling steps from a place already found, then by halving. Common ends slice
both lists into groups; the ranks of the ends around a group give the tokens that overlap in it. Links are the pairs of
tokens that end together.

Token bytes that end together are one the end of the other, so the pairs of ids that can ever be linked number no more
than the ends of tokens of either vocabulary that are tokens of the other. That bound depends on the two files alone, and
so the table of all linked pairs and their counts can be sent to every task, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from ._words import in_pieces

#: Bytes of text encoded at once.
AT_ONCE = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def byte_level(path: str):
    """(encode, token bytes by id) of a byte-level vocabulary; special strings inside texts are plain text.

    Where ids follow the merges, as each token then is what its own merge makes, texts are encoded by the same vocabulary as
    ranks, which gives the same ids in a fifth of the time; else by the library that the file is for.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    file = json.loads(t.to_str())
    of, names = _byte_letters(), {x["id"] for x in file["added_tokens"]}
    table = [bytes(of[c] for c in t.id_to_token(i)) if i not in names and t.id_to_token(i) else b"" for i in range(t.get_vocab_size())]
    model, split = file["model"], file["pre_tokenizer"]
    pairs = ["".join(x) if isinstance(x, list) else x.replace(" ", "", 1) for x in model["merges"]]
    ranked = all(model["vocab"].get(x) == 256 + k for k, x in enumerate(pairs)) and len(model["vocab"]) == 256 + len(pairs)
    plain = file["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not model.get("ignore_merges")
    if ranked and plain:
        ranks = {table[i]: i for i in model["vocab"].values()}
        by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [by_rank.encode_ordinary(x.decode()) for x in texts]), table
    return (lambda texts: [x.ids for x in t.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]), table


@lru_cache(2)
def pieces(path: str):
    """(encode, token bytes by id) of a piece vocabulary: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)

    def of(i: int) -> bytes:
        if p.is_control(i) or p.is_unknown(i):
            return b""
        piece = p.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if p.is_byte(i) else piece.replace("▁", " ").encode()

    table = [of(i) for i in range(p.get_piece_size())]
    return (lambda texts: p.encode([x.decode() for x in texts], out_type=int, num_threads=1)), table


def most_links(a: list[bytes], b: list[bytes]) -> int:
    """A bound of the pairs of ids that can be linked: each end of a token that is a token of the other vocabulary."""
    def ends(of: list[bytes], within: list[bytes]) -> int:
        times: dict[bytes, int] = {}
        for x in within:
            times[x] = times.get(x, 0) + 1
        return sum(times.get(x[k:], 0) for x in of for k in range(len(x)))

    return ends(a, b) + ends(b, a)


def gallop(driver: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each entry of ``driver`` the number of entries of ``longer`` below it; both increase.

    Entries are taken at halving strides: an entry starts from the place of the one before it that is known, doubles its
    step until it has passed its value or the place of the next known entry, and halves the last step. All entries of a
    stride are searched together.
    """
    n, m = len(driver), len(longer)
    at = np.full(n + 1, m, np.int64)  # the place of an end that all entries are below
    stride = 1 << max(n - 1, 0).bit_length()
    low = np.append(longer, np.iinfo(np.int64).max)  # nothing is passed at the end
    if n:
        at[0] = np.searchsorted(longer, driver[0])
    while stride > 1:
        half = stride >> 1
        mine = np.arange(half, n, stride)
        want, lo, hi = driver[mine], at[mine - half], at[np.minimum(mine + half, n)]
        step, go = np.ones(len(mine), np.int64), np.arange(len(mine))
        top = lo.copy()
        while len(go):  # doubling: all below lo + step - 1 are passed
            probe = np.minimum(lo[go] + step[go] - 1, hi[go])
            passed = (low[probe] < want[go]) & (probe < hi[go])
            top[go[~passed]] = probe[~passed]
            go = go[passed]
            lo[go] = probe[passed] + 1
            step[go] *= 2
        go = np.flatnonzero(lo < top)
        while len(go):  # halving
            mid = (lo[go] + top[go]) >> 1
            below = low[mid] < want[go]
            lo[go[below]] = mid[below] + 1
            top[go[~below]] = mid[~below]
            go = go[lo[go] < top[go]]
        at[mine] = lo
        stride = half
    return at[:n]


class Common(NamedTuple):
    """Common ends of all documents in order: their document, and the ranks of the A and the B token that end there."""

    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray


def common_ends(ends_a: np.ndarray, n_a: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray) -> Common:
    """``ends_*``: ends of all documents' tokens on one scale, increasing; ``n_*``: tokens of each document. Ranks count over all."""
    doc_a, doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    a_drives = n_a <= n_b
    by_a, by_b = np.flatnonzero(a_drives[doc_a]), np.flatnonzero(~a_drives[doc_b])  # the shorter list of each document
    to_b, to_a = np.flatnonzero(a_drives[doc_b]), np.flatnonzero(~a_drives[doc_a])  # the longer one
    found = []
    for drive, ends, other, others in ((by_a, ends_a, to_b, ends_b), (by_b, ends_b, to_a, ends_a)):
        values, longer = ends[drive], others[other]
        at = gallop(values, longer)
        met = np.flatnonzero(at < len(longer))
        met = met[longer[at[met]] == values[met]]
        found.append((drive[met], other[at[met]]))
    a = np.concatenate((found[0][0], found[1][1]))
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.concatenate((found[0][1], found[1][0]))[order]
    return Common(doc_a[a], a, b)


def overlaps(common: Common, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """A row (document, first A, A after the last, first B, B after the last) for each group, ranks within the document."""
    first = np.concatenate(([True], common.doc[1:] != common.doc[:-1]))[: len(common.doc)]
    rows = [common.doc]
    for rank, n in ((common.a, n_a), (common.b, n_b)):
        own = rank - (np.cumsum(n) - n)[common.doc] + 1
        rows += [np.where(first, 0, np.concatenate(([0], own[:-1]))[: len(own)]), own]
    return np.stack(rows, axis=1)


@lru_cache(1)
def _names(size: int) -> np.ndarray:
    """Decimal ids with a separator behind them: ``size`` with a comma, with a bar, with a semicolon and with none."""
    return np.array([f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(size)], f"S{len(str(size)) + 1}")


def _digests(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, common: Common) -> list[str]:
    """SHA-256 of each document's groups as text, '' for a document without tokens."""
    size = 1 << 16
    names = _names(size)
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[common.a], mark_b[common.b] = 1, 1
    group_a, group_b = np.cumsum(mark_a) - mark_a, np.cumsum(mark_b) - mark_b  # the group of each token, over all documents
    of_a, of_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=len(common.a))))) for g in (group_a, group_b))
    text = np.empty(len(ids_a) + len(ids_b), names.dtype)
    text[np.arange(len(ids_a)) + of_b[group_a]] = names[ids_a + mark_a * size]  # behind the B tokens of the groups before
    ends = np.cumsum(n_b)[n_b > 0] - 1
    mark_b *= 2
    mark_b[ends] = 3
    text[np.arange(len(ids_b)) + of_a[group_b + 1]] = names[ids_b + mark_b * size]  # behind the A tokens up to their group
    letters = text.view(np.uint8).reshape(len(text), -1)
    some = letters != 0
    sizes = some.sum(1)
    flat = letters[some].tobytes()
    cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
    return [hashlib.sha256(flat[s:e]).hexdigest() if s < e else "" for s, e in zip(cuts, cuts[1:], strict=False)]


def _encoded(texts: list[bytes | None], a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and their number in each text by both vocabularies; none where a text is empty or the bytes do not come back."""
    (encode_a, bytes_a), (encode_b, bytes_b) = byte_level(a), pieces(b)
    rows_a: list[list[int]] = []
    rows_b: list[list[int]] = []
    some = [x or b"" for x in texts]
    for x, ids_a, ids_b in zip(some, encode_a([b" " + x for x in some]), encode_b(some), strict=True):
        whole = b" " + x
        fits = x and b"".join(map(bytes_a.__getitem__, ids_a)) == whole and b"".join(map(bytes_b.__getitem__, ids_b)) == whole
        rows_a.append(ids_a if fits else [])
        rows_b.append(ids_b if fits else [])
    out = []
    for rows in (rows_a, rows_b):
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        out += [np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())), n]
    return tuple(out)


@lru_cache(2)
def _lengths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.fromiter(map(len, table), np.int64, len(table)) for _, table in (byte_level(path_a), pieces(path_b)))


def _aligned(a: str, b: str):
    """(doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times): the distinct linked id pairs of each text and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1, AT_ONCE):
                ids_a, n_a, ids_b, n_b = _encoded(piece.column(1).to_pylist(), a, b)
                size_a, size_b = _lengths(a, b)
                common = common_ends(np.cumsum(size_a[ids_a]), n_a, np.cumsum(size_b[ids_b]), n_b)
                groups = np.bincount(common.doc, minlength=len(n_a))
                pairs = len(size_a) * len(size_b)
                keys, times = np.unique(common.doc * pairs + ids_a[common.a] * len(size_b) + ids_b[common.b], return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(n_a) + 1) * pairs).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % pairs // len(size_b), keys % len(size_b), times)]
                digests = pa.array(_digests(ids_a, n_a, ids_b, n_b, common), pa.string())
                cols = [piece.column(0), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, groups)), digests, *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "times"])

    return run


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, a, b, times) of each whole text, the last three one entry for each distinct link."""
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_aligned(a, b), f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a array<int>, b array<int>, times array<int>")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) summed over a task; there are no more pairs than the vocabularies allow."""
    keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        of = [batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
        keys, at = np.unique(np.concatenate((keys, of[0] << 32 | of[1])), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, at, np.concatenate((total, of[2])))
        total = n
    yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], names=["a", "b", "n"])


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links hold an id pair, and whether no pair of its B id has more."""
    n = aligned.select("a", "b", "times").mapInArrow(_partial, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    n = materialise(n, "link-counts")
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    return n.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            of = [batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            row, at = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(keys, of[0] << 32 | of[1])
            n_best, count_sum, links = (np.zeros(len(sizes), np.int64) for _ in range(3))
            np.add.at(n_best, row, of[2] * best[at])
            np.add.at(count_sum, row, of[2] * n[at])
            np.add.at(links, row, of[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3, 8)), *map(pa.array, (links, n_best, count_sum))],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"])

    return run


def alignment_report(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each whole text.

    ``a`` is the path of a byte-level vocabulary that encodes a space and the text, ``b`` of a piece vocabulary that puts
    the space itself; both have at most 65 536 ids. A text that is null or empty, or whose bytes either does not give back, has no tokens: zeros and an
    empty digest. ``n_best`` counts the links whose pair no other pair of their B id exceeds in the corpus, ties included;
    ``count_sum`` adds the corpus-wide counts of the links' pairs. Repeated rows count each; other columns are not carried;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    aligned = materialise(align(docs, a, b), "aligned")
    most = most_links(byte_level(a)[1], pieces(b)[1])
    counts = link_counts(aligned).toArrow()  # at most `most` rows: a bound of the vocabularies
    if counts.num_rows > most:
        raise RuntimeError(f"{counts.num_rows} linked pairs, where the vocabularies allow {most}")
    keys = counts["a"].to_numpy().astype(np.int64) << 32 | counts["b"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], counts["n"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)))
    kind = aligned.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint"
    out = aligned.select("a", "b", "times", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").mapInArrow(_scored(shared), schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
