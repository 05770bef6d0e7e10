"""Byte-pair encoding with word ends, by contiguous rank arrays, and decoding.

The vocabulary file is that of a public tokenizer (normal form C, white space collapsed, lower case, split pattern,
byte alphabet, ``</w>`` after the last symbol of a piece). A short piece holds its parts and the ranks of adjacent
pairs contiguously: the smallest rank is found by a scan, its right boundary deleted, the two neighbouring ranks
refreshed. All new pieces of equal length are rows of one pair of arrays, so that a step of all of them is one array
operation; every step shortens each row by one, and rows without a rank left are done. Pieces of over ``SHORT`` parts
take the same merges from a heap, as scans would be quadratic.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 48
#: Characters of the texts that a worker splits into words at a time.
STEP = 1_500_000
#: Words whose ids a worker keeps; beyond that it starts anew. It changes speed only.
CACHE = 600_000
NO_RANK = 1 << 60
#: White space that str.split() knows and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_MARKS = frozenset(".,!?;:")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Characters outside the ranges in which normal form, lower case and split agree with the library in any order: other
#: marks, and letters that only one of the two Unicode tables knows. A text that holds one is split by the library itself.
_UNTESTED = re.compile("[^\0-\u0482\u048a-\u052f\u0531-\u0556\u0561-\u0586\u05d0-\u05ea\u1e00-\u1f15\u2000-\u206f\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u2500-\u2bff\u3000-\u3029\u3030-\u303f\u3041-\u3096\u309b-\u30ff\u3400-\u4db5\u4e00-\u9fd5\uac00-\ud7a3\ufe0e\ufe0f\uff01-\uffee\U0001f300-\U0001f9ff]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """One vocabulary: ``encode`` gives the ids of a text as bytes (little-endian unsigned 32-bit), ``decode`` the text of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.wide = 1 << 20
        self.rank = {vocab[a] * self.wide + vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.ids = np.array(self.merged, np.int64)
        self._hash(np.fromiter(self.rank, np.int64, len(self.rank)))
        end = model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.inner, self.last = (np.array([vocab[c + tail] for c in letters], np.int64) for tail in ("", end))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.token = [tokens[i].encode() for i in range(len(tokens))]
        self.path, self.bytes_of = path, {c: b for b, c in enumerate(letters)}
        self.known: dict[str | tuple[str], bytes] = {}

    def _hash(self, keys: np.ndarray, bits: int = 19) -> None:
        """An open-addressed table of the pairs: slots of keys and of ranks, and the longest probe."""
        self.shift, self.slots, self.slot_rank = 64 - bits, np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            place = at[left]
            free = self.slots[place] == -1
            self.slots[place[free]] = keys[left[free]]  # of those that want one slot the last gets it
            won = self.slots[place] == keys[left]
            self.slot_rank[place[won]] = left[won]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it has none."""
        keys = (a * self.wide + b).ravel()
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at_ = (at[open_] + step) & (len(self.slots) - 1)
            found = self.slots[at_]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at_[hit]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(a.shape)

    def merge_equal(self, raw: list[bytes]) -> list[bytes]:
        """The ids of pieces of one length in bytes, as bytes."""
        parts = self.inner[np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)]
        parts[:, -1] = self.last[[x[-1] for x in raw]]
        out, rows = [b""] * len(raw), np.arange(len(raw))

        def done(which: np.ndarray, ids: np.ndarray) -> None:
            data, w = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, r in enumerate(which.tolist()):
                out[r] = data[k * w : k * w + w]

        ranks = self.ranks_of(parts[:, :-1], parts[:, 1:])
        while len(rows) and ranks.shape[1]:
            i = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), i]
            if (over := least == NO_RANK).any():
                done(rows[over], parts[over])
                on = ~over
                rows, parts, ranks, i, least = rows[on], parts[on], ranks[on], i[on], least[on]
                if not len(rows):
                    break
            n, width = ranks.shape
            at = np.arange(n)
            parts[at, i] = self.ids[least]
            keep = np.ones((n, width + 1), bool)
            keep[at, i + 1] = False
            parts = parts[keep].reshape(n, width)
            keep = keep[:, 1:]
            ranks = ranks[keep].reshape(n, width - 1)
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i < width - 1)
            ranks[left, i[left] - 1] = self.ranks_of(parts[left, i[left] - 1], parts[left, i[left]])
            ranks[right, i[right]] = self.ranks_of(parts[right, i[right]], parts[right, i[right] + 1])
        if len(rows):
            done(rows, parts)
        return out

    def merge_many(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece of the split pattern."""
        by: dict[int, tuple[list[str], list[bytes]]] = {}
        out = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            if len(raw) > SHORT:
                out[p] = array("I", self._merge_long([*self.inner[list(raw[:-1])].tolist(), int(self.last[raw[-1]])])).tobytes()
            else:
                names, raws = by.setdefault(len(raw), ([], []))
                names.append(p)
                raws.append(raw)
        for names, raws in by.values():
            out.update(zip(names, self.merge_equal(raws), strict=True))
        return out

    def _merge_long(self, parts: list[int]) -> list[int]:
        rank, wide, n = self.rank.get, self.wide, len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] * wide + parts[i + 1])) is not None]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if (r := rank(parts[i] * wide + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = self.merged[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [p for p, on in zip(parts, live, strict=True) if on]

    def learn(self, words: set[str | tuple[str]]) -> None:
        """Put the ids of normalised words between white space, and of pieces that the library split off, into ``known``."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        known, marks = self.known, _MARKS
        split = [w for w in words if isinstance(w, tuple)]
        plain, marked, other, wanted = [], [], {}, {p for (p,) in split}
        for w in words.difference(split):
            if w.isalpha():
                plain.append(w)
            elif w[-1] in marks and w[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in known:
                    wanted.add(w[:-1])
            else:
                other[w] = self.pieces(w)
        ids = self.merge_many(list(wanted.union(plain, marks, *other.values())))
        known.update(zip(plain, map(ids.__getitem__, plain)))
        known.update([(w, (ids.get(w[:-1]) or known[w[:-1]]) + ids[w[-1]]) for w in marked])
        known.update([(w, b"".join([ids[p] for p in x])) for w, x in other.items()])
        known.update([(w, ids[w[0]]) for w in split])

    @staticmethod
    def words(text: str) -> list[str]:
        """Normalised words between white space."""
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        return [w for w in _SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split(self, text: str) -> list[str | tuple[str]]:
        """``words``, or the pieces that the library makes of a text with characters that are not tested."""
        if text.isascii() or not _UNTESTED.search(text):
            return self.words(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [(bytes(map(self.bytes_of.__getitem__, p)).decode(),) for p, _ in found]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes, some ``STEP`` characters at a time."""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < STEP:
                text = texts[at]
                parts = self.special_split.split(text) if "<|" in text else [text]
                held.append([self.split(x) if not k & 1 else self.special[x] for k, x in enumerate(parts)])
                size, at = size + len(text), at + 1
            wanted = set().union(*(p for parts in held for p in parts if isinstance(p, list)))
            if new := wanted.difference(self.known):
                if len(self.known) + len(new) > CACHE:
                    self.known.clear()
                    new = wanted
                self.learn(new)
            known = self.known.__getitem__
            for parts in held:
                yield b"".join([b"".join(map(known, p)) if isinstance(p, list) else array("I", [p]).tobytes() for p in parts])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' own strings with a blank between them: the file names no decoder."""
        return b" ".join(map(self.token.__getitem__, array("I", ids)))


@lru_cache(2)
def load(path: str) -> WordBpe:
    """One copy for each Python worker."""
    return WordBpe(path)


def round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(``id_col``, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each whole text, encoded and decoded again.

    ``vocab`` is the path of the vocabulary file, the same on every executor. Special strings inside a text become
    their ids, as the tokenizer's default has it. A null or empty text has no ids, and its decoded text is empty. Rows
    are independent: ids may be null or repeat. An empty table gives an empty result.
    """
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kinds = [docs.schema[id_col].dataType.simpleString(), "bigint", "string", "string", "array<int>", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(vocab), hashlib.sha256
        for batch in batches:
            n, digests, back, all_ids, all_texts = [], [], [], [], []
            for ids in bpe.encode_all([x or "" for x in batch.column(1).to_pylist()]):
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                digests.append(sha(ids).hexdigest())
                back.append(sha(decoded).hexdigest())
                if with_ids:
                    all_ids.append(list(array("I", ids)))
                    all_texts.append(decoded.decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"`{a}` {b}" for a, b in zip(names, kinds))  # noqa: B905
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32): each document's ids and one ``end_id``, cut after every ``capacity`` ids.

    A null or empty text is the one id ``end_id``.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    tail, step = array("I", [end_id]).tobytes(), 4 * capacity
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, crc = load(vocab), zlib.crc32
        for batch in batches:
            row, piece, length, crcs = [], [], [], []
            for k, ids in enumerate(bpe.encode_all([x or "" for x in batch.column(1).to_pylist()])):
                ids += tail
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(k)
                    piece.append(p)
                    length.append(len(part) // 4)
                    crcs.append(crc(part))
            at = pa.array([p * capacity for p in piece], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), at, pa.array(length, pa.int64()), pa.array(crcs, pa.int64())], names=names)

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
