"""Language identification by fusing evidence.

The posterior of a language is proportional to the product of: the likelihood of the text (byte trigrams, tempered, as
neighbouring trigrams are not independent); the likelihood of the declared markup language and of the address suffix
given the language; and a prior of the host, smoothed towards its domain, which is smoothed towards all rows. The last
three are learned from the rows at hand by grouped aggregation of their text-only posteriors; a row's own text is taken
out of its priors again. A background class, in which all trigrams are equally likely, takes what is in no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drawn, materialise

BUCKETS = 1 << 15
NONE = "und"
#: Trigrams from which on the weight of a text no longer grows, and the share of a trigram's log likelihood that counts.
SATURATION = 200
TEMPER = 1 / 3
_DIGIT = re.compile(r"\d").search


@dataclass(frozen=True)
class TextModel:
    """``table``: log likelihood of each bucket of trigrams (rows) for each of ``langs`` and the background (columns)."""

    langs: tuple[str, ...]
    table: np.ndarray


def trigrams(text: str) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased words between single blanks; words with digits (numbers, keys,
    addresses) are in no language and left out."""
    words = [w for w in text.lower().split() if w.isalpha() or not _DIGIT(w)]
    raw = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 4:  # no or one letter
        return np.zeros(0, np.uint32)
    return ((raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)


def fit_text_model(docs: DataFrame, sample: int = 3000, least: int = 3, most: int = 200) -> TextModel:
    """Fit on about ``sample`` documents of each value of ``lang`` (those with the smallest hashes); languages with fewer
    than ``least`` documents are left out. ``sample`` bounds the training set alone. Nulls are ignored. More than ``most``
    languages are an error, as the driver holds a table of 32 768 counts for each."""
    named = docs.where("lang is not null and text is not null and doc_id is not null").select(F.lower("lang").alias("lang"), "text", "doc_id")
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().where(F.col("count") >= least).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages have {least} or more documents")
    langs = tuple(sorted(sizes))
    if not langs:
        return TextModel((), np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    part = named.where(F.col("lang").isin(*langs)).where(drawn("doc_id", 5, share[F.col("lang")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(BUCKETS, np.int64) for k in langs}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(t[at], pa.int64())], names=["lang", "gram", "n"])

    rows = part.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = rows.select("gram", F.array_position(F.array(*[F.lit(k) for k in langs]), F.col("lang")).alias("at"), "n").toArrow()
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["gram"].to_numpy(), rows["at"].to_numpy() - 1] = rows["n"].to_numpy()
    alpha = 0.1
    table = np.log((counts + alpha) / (counts.sum(0) + alpha * BUCKETS))
    return TextModel(langs, np.hstack((table, np.full((BUCKETS, 1), -np.log(BUCKETS)))).astype(np.float32))


def evidence(model: TextModel, text: str) -> np.ndarray:
    """Tempered log likelihood of the text for each language and the background, less the largest; zeros without trigrams."""
    grams = trigrams(text)
    if not len(grams):
        return np.zeros(model.table.shape[1])
    total = np.zeros(model.table.shape[1])
    for at in range(0, len(grams), 1 << 16):
        total += model.table[grams[at : at + (1 << 16)]].sum(0, dtype=np.float64)
    total *= TEMPER * min(1.0, SATURATION / len(grams))
    return total - total.max()


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def identify(rows: DataFrame, model: TextModel, id_col: str = "id", host_weight: float = 20.0, background: float = 1e-3, smoothing: float = 5.0) -> DataFrame:
    """(``id_col``, lang, posterior, text_lang) for ``rows`` (``id_col``, text, declared, suffix, host, domain).

    Any value may be null: missing evidence counts for nothing, a missing host takes the prior of all rows. Declared
    values outside the model's languages are one value. Empty texts are decided by the other evidence; with none they
    get the most frequent language. Ids may be null or repeat. ``lang`` is ``und`` where the background wins, and for
    all rows if the model has no languages. An empty table gives an empty result.
    """
    langs = (*model.langs, NONE)
    kind = rows.schema[id_col].dataType.simpleString()
    named = F.lower(F.col("declared"))
    declared = F.when(named.isin(*model.langs), named).when(named.isNotNull() & (F.trim(named) != ""), F.lit("?"))
    own = rows.select(F.col(id_col).alias("id"), "text", declared.alias("declared"), "suffix", "host", "domain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_prior = np.log(np.array([(1 - background) / max(1, len(model.langs))] * len(model.langs) + [background]))
        for batch in batches:
            e = [evidence(model, t or "") for t in batch.column(1).to_pylist()]
            p = [np.exp(x + log_prior - (x + log_prior).max()) for x in e]
            p = [x / x.sum() for x in p]
            cols = [batch.column(0), *(batch.column(k) for k in range(2, 6)), pa.array([x.tolist() for x in e], pa.list_(pa.float64())), pa.array([x.tolist() for x in p], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "declared", "suffix", "host", "domain", "e", "p"])

    scored = own.mapInArrow(run, f"id {kind}, declared string, suffix string, host string, domain string, e array<double>, p array<double>")
    scored = materialise(scored, "scored")
    width = range(len(langs))
    total = lambda df, prefix: df.select(*[F.sum(F.col("p")[k]).alias(f"{prefix}{k}") for k in width])
    per = lambda key, prefix: scored.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(F.col("p")[k]).alias(f"{prefix}{k}") for k in width])
    everything = total(scored, "g").first()
    mass = [x or 0.0 for x in everything]
    n = sum(mass)
    overall = [(x + 1) / (n + len(langs)) for x in mass]
    with_all = scored
    for key, prefix in (("declared", "c"), ("suffix", "s"), ("domain", "d"), ("host", "h")):
        found = per(key, prefix)  # ``declared`` has one row for each language of the model and one more at most
        with_all = with_all.join(F.broadcast(found) if key == "declared" else found, key, "left")
    terms = []
    values = {key: scored.where(F.col(key).isNotNull()).select(F.approx_count_distinct(key)).first()[0] + 1 for key in ("declared", "suffix")}
    domain_total = _sum([F.coalesce(F.col(f"d{k}"), F.lit(0.0)) for k in width])
    host_total = _sum([F.coalesce(F.col(f"h{k}"), F.lit(0.0)) for k in width])
    for k in width:
        mine = F.col("p")[k]
        less = lambda c, mine=mine: F.greatest(F.coalesce(F.col(c) - mine, F.lit(0.0)), F.lit(0.0))
        given = lambda key, c, less=less, k=k: F.when(F.col(key).isNull(), F.lit(0.0)).otherwise(F.log((less(c) + smoothing / values[key]) / F.lit(mass[k] + smoothing)))
        domain = (less(f"d{k}") + host_weight * F.lit(overall[k])) / (F.greatest(domain_total - 1, F.lit(0.0)) + host_weight)
        prior = (less(f"h{k}") + host_weight * domain) / (F.greatest(host_total - 1, F.lit(0.0)) + host_weight)
        terms.append(F.col("e")[k] + given("declared", f"c{k}") + given("suffix", f"s{k}") + F.log(prior))
    fused = with_all.withColumn("logs", F.array(*terms)).withColumn("top", F.array_max("logs"))
    best = F.array_position("logs", F.col("top")) - 1
    text_best = F.array_position("p", F.array_max("p")) - 1
    names = F.array(*[F.lit(x) for x in langs])
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return fused.select(F.col("id").alias(id_col), F.get(names, best.cast("int")).alias("lang"), posterior.alias("posterior"), F.get(names, text_best.cast("int")).alias("text_lang"))


_DROP = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def visible_text(html: str) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return unescape(_TAG.sub(" ", _DROP.sub(" ", html)))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, host, domain) of ``pages`` (page_id, url, html); what is missing is null.

    ``declared`` is the language part of the html tag's lang, ``suffix`` the last label of the host, ``domain`` its last
    two labels (its own name for an address of numbers).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3)], names=["page_id", "text", "declared", "host"])

    tag = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", 1)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "html", F.nullif(tag, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    rows = rows.mapInArrow(run, f"page_id {kind}, text string, declared string, host string")
    label = F.regexp_extract("host", r"\.([a-z]{2,24})$", 1)
    two = F.regexp_extract("host", r"([^.]+\.[a-z]{2,24})$", 1)
    return rows.select("page_id", "text", "declared", F.nullif(label, F.lit("")).alias("suffix"), "host", F.coalesce(F.nullif(two, F.lit("")), F.col("host")).alias("domain"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, lang, posterior, text_lang) of each page."""
    return identify(page_evidence(pages), model, "page_id")


def keep_languages(docs: DataFrame, model: TextModel, accept: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in an accepted language (default: all of the model's) with a posterior of ``least`` or more.

    The lang column is the declared language and the source column stands for the host. Rows without any letter, and
    those that the background takes, go. Rows are told apart by doc_id and text, so repeated rows share a decision;
    all columns are kept as they are.
    """
    accept = model.langs if accept is None else accept
    key = F.struct(F.col("doc_id").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    none = F.lit(None).cast("string")
    rows = docs.select(key.alias("id"), "text", F.col("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))
    told = identify(rows.where(F.col("text").rlike(r"\p{L}")), model)
    good = told.where(F.col("lang").isin(*accept) & (F.col("posterior") >= least)) if accept else told.limit(0)
    good = good.select("id").distinct()
    marked = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return marked.join(good, marked["key"].eqNullSafe(good["id"]), "left_semi").select("row.*")
