"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. The score of a labelling is a sum over lines of weights times the features of the line, of
the line before it and of the line after it, and over neighbours of a weight for each pair of labels. Forward-backward
gives each line's probability of being good; their mean, weighted by the lines' lengths, is the document's good share,
and a logistic curve fitted on the training documents turns it into a probability.

Labels are given for documents, not lines. All lines of a good document are good. Which lines of a bad document are bad
is filled in: first a model that calls them all bad is fitted, then those lines of bad documents count as bad that it
finds worse than nearly all lines of good documents (the worst one always does), and the model is fitted again.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drawn

#: Features of one line; the last is 1 for a line that exists.
WIDTH = 16
BINS = 3 * WIDTH


def line_features(lines: list[str]) -> np.ndarray:
    """(lines, WIDTH): surface statistics of each line, each between 0 and about 1."""
    out = np.zeros((len(lines), WIDTH))
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    for k, line in enumerate(lines):
        words, n, count = line.split(), len(line), line.count
        m = len(words) or 1
        bars, bangs, marks = count("|"), count("!"), count("$") + count("%") + count("&") + count("*") + count("#") + count("@") + count("~") + count("^")
        out[k] = (
            sum(map(str.isupper, words)) / m, 1 - len(set(words)) / m, sum(map(eq, words, words[1:])) / m, min(1.0, bars / m), min(1.0, bangs / m), min(1.0, marks / m),
            sum(map(str.isalpha, words)) / m, sum(map(str.istitle, words)) / m, min(1.0, (count("<") + count("{") + count("}") + count("=") + count("/") + count("\\") + count("_")) / m),
            min(1.0, sum([count(d) for d in "0123456789"]) / n), min(1.0, (n - m + 1) / m / 20), min(1.0, np.log1p(m) / 8), float(line[-1:] in ".!?…:;\"'"), min(1.0, (count(".") + count(",")) / m),
            float(seen[line] > 1), 1.0,
        )
    return out


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()]


def neighbourhood(f: np.ndarray) -> np.ndarray:
    """(lines, 3 WIDTH): each line's features, the previous line's and the next line's; zeros beyond the ends."""
    none = np.zeros((1, f.shape[1]))
    return np.hstack((f, np.vstack((none, f[:-1])), np.vstack((f[1:], none))))


@dataclass(frozen=True)
class Model:
    """``emit``: weight of each neighbourhood feature for good against bad; ``pairs``: of label pairs (bad 0, good 1);
    ``slope``, ``offset``: from good share to probability; ``base``: the score of a text without lines."""

    emit: np.ndarray
    pairs: np.ndarray
    slope: float
    offset: float
    base: float


def marginals(emit: np.ndarray, pairs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many documents at once.

    ``emit``: each line's log weight of good against bad; ``starts``, ``counts``: the lines of each document, with at
    least one line each. Returns each line's probability of being good and the expected number of each pair of labels.
    """
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    active = [int(np.searchsorted(-counts, -t, side="left")) for t in range(longest)]  # documents with more than t lines
    m, n = np.exp(pairs - pairs.max()), len(emit)
    psi = np.stack((1 / (1 + np.exp(np.clip(emit, -500, 500))), 1 / (1 + np.exp(-np.clip(emit, -500, 500)))), 1) + 1e-300
    alpha, beta, expected = np.zeros((n, 2)), np.ones((n, 2)), np.zeros((2, 2))
    for t in range(longest):
        at = starts[: active[t]] + t
        alpha[at] = psi[at] if t == 0 else psi[at] * (alpha[at - 1] @ m)
        alpha[at] /= alpha[at].sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        right = psi[at + 1] * beta[at + 1]
        b = right @ m.T
        both = alpha[at][:, :, None] * m[None] * right[:, None, :]
        expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), expected


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, starts: np.ndarray, counts: np.ndarray, rounds: int, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood of line labels ``y`` by Adam; ``weight``: of each line's document."""
    w, pairs = np.zeros(x.shape[1]), np.zeros((2, 2))
    first = np.zeros(len(y), bool)
    first[starts] = True
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    total = weight.sum()
    params, m, v = np.concatenate((w, pairs.ravel())), 0.0, 0.0
    for k in range(1, rounds + 1):
        w, pairs = params[:-4], params[-4:].reshape(2, 2)
        good, expected = marginals(x @ w, pairs, starts, counts)
        g = np.concatenate((x.T @ (weight * (y - good)) / total, ((seen - expected) / max(1, len(inner))).ravel())) - l2 * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return params[:-4], params[-4:].reshape(2, 2)


def _good_share(good: np.ndarray, length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts) if len(starts) else np.zeros(0)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 150) -> Model:
    """Fit on documents given as (line features, line lengths) with labels 1 good, 0 bad; documents without lines count for ``base`` only."""
    base = (labels.sum() + 1) / (len(labels) + 2)
    used = [k for k, (f, _) in enumerate(docs) if len(f)]
    labels = labels[used]
    if not used or labels.min() == labels.max():
        return Model(np.zeros(BINS), np.zeros((2, 2)), 0.0, float(np.log(base / (1 - base))), float(base))
    counts = np.array([len(docs[k][0]) for k in used])
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    x, length = np.vstack([neighbourhood(docs[k][0]) for k in used]), np.concatenate([docs[k][1] for k in used])
    doc, y = np.repeat(np.arange(len(used)), counts), np.repeat(labels, counts)
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / counts  # classes and documents count alike
    weight = (share * len(y))[doc]
    for step in range(3):
        emit, pairs = _train(x, y, weight, starts, counts, rounds)
        good, _ = marginals(x @ emit, pairs, starts, counts)
        if step < 2:
            line = (x @ emit) + 0.0
            limit = np.quantile(line[labels[doc] == 1], 0.02)
            worst = np.minimum.reduceat(line, starts)
            y = np.where(labels[doc] == 1, 1, np.where((line <= limit) | (line <= worst[doc]), 0, 1))
    g = _good_share(good, length, starts)
    slope, offset = 0.0, 0.0
    for _ in range(200):  # Newton steps of a logistic curve with a weak prior
        p = 1 / (1 + np.exp(-(slope * g + offset)))
        a = np.stack((g, np.ones_like(g)), 1)
        h = a.T @ (a * (p * (1 - p))[:, None]) + np.diag([0.05, 0.05])
        step_ = np.linalg.solve(h, a.T @ (labels - p) - 0.05 * np.array([slope, offset]))
        slope, offset = slope + step_[0], offset + step_[1]
        if np.abs(step_).max() < 1e-8:
            break
    return Model(emit, pairs, float(slope), float(offset), float(base))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """The probability that each text is good."""
    lines = [lines_of(t) for t in texts]
    used = [k for k, x in enumerate(lines) if x]
    out = np.full(len(texts), model.base)
    if used:
        counts = np.array([len(lines[k]) for k in used])
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        emit = np.concatenate([neighbourhood(line_features(lines[k])) @ model.emit for k in used])
        good, _ = marginals(emit, model.pairs, starts, counts)
        length = np.array([len(x) for k in used for x in lines[k]], float)
        out[used] = 1 / (1 + np.exp(-(model.slope * _good_share(good, length, starts) + model.offset)))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_lines: int = 512) -> Model:
    """Fit on about ``sample`` labelled documents that are not held out, those with the smallest hashes of their id.

    ``sample`` and ``most_lines`` bound the training set alone: of a document of more lines, so many neighbouring ones
    from a place drawn by its id count. What reaches the driver is these lines' features. Labels that are null, not
    0 or 1, or without a document are ignored.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    n = usable.count()
    part = usable.where(drawn("doc_id", 17, F.lit(min(1.0, sample / max(1, n)))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(part), "doc_id")  # about ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats, lens = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = lines_of(text)
                at = random.Random(doc_id).randrange(max(1, len(lines) - most_lines + 1))
                feats.append(line_features(lines)[at : at + most_lines].astype(np.float32).tobytes())
                lens.append(np.array([len(x) for x in lines[at : at + most_lines]], np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.binary()), pa.array(lens, pa.binary())], names=["doc_id", "quality", "f", "n"])

    got = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id bigint, quality int, f binary, n binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["f"])))
    found = [(np.frombuffer(r["f"], np.float32).astype(float).reshape(-1, WIDTH), np.frombuffer(r["n"], np.float32).astype(float)) for r in got]
    return train(found, np.array([r["quality"] for r in got], int))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each whole text.

    Only the text enters a score. Null texts count as empty, and texts without a line that is not blank score the
    training share of good documents. Rows are independent: ids may be null (held_out is then null) or repeat. An empty
    table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts = [scores(model, texts[at : at + 256]) for at in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns; texts without lines go or stay by the model's base."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keep = np.concatenate([scores(model, texts[at : at + 256]) >= least for at in range(0, len(texts), 256)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
