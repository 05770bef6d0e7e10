"""Benchmark decontamination against windows compared one by one."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from linepack.llm import decontaminate as D


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(len(v), width)
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1 if v else 0):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    met.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def texts(rnd, n, vocabulary=12, longest=60):
    return [" ".join(rnd.choice("abcdefghijklmnop"[:vocabulary]) for _ in range(rnd.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 3, 10])
def test_phrases_in_small_vocabularies(spark, width):
    rnd = random.Random(width)
    docs = [(i, t) for i, t in enumerate(texts(rnd, 60, 3) + ["a " * 400, "A-b,C" * 90])]
    items = [(i, t) for i, t in enumerate(texts(rnd, 8, 3, 16) + ["a b c", "a"])]
    docs[7] = (7, f"x {items[3][1]} y {items[3][1]} z")
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), width)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, width)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, "İ one TWO three"), (None, "one two three"), (3, "ßéÉ 日本 x1 2"), (4, "\x00 \x7f one-two_three"), (4, "\x00 \x7f one-two_three"), (5, "one two"), (6, "word " * 50_000)]
    items = [(1, None), (2, ""), (3, "One, two three!"), (3, "日本 X1"), (None, "2"), (11, "word word"), (100, "three")]
    wide = spark.createDataFrame([(*d, 1, "b") for d in docs], "doc_id long, text string, slot int, block string")
    tests = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    assert sorted(map(tuple, D.contamination(wide, tests).collect()), key=str) == plain(docs, items)
    assert D.contamination(wide.limit(0), tests).count() == 0
    assert {r.n_hit for r in D.contamination(wide, tests.limit(0)).collect()} == {0}


def test_sets_of_items_give_the_same(spark, monkeypatch):
    rnd = random.Random(3)
    docs, items = list(enumerate(texts(rnd, 50))), [(i, t) for i, t in enumerate(texts(rnd, 40, 12, 30))]
    items += [(90 + i, docs[i][1][5:80]) for i in range(5)]
    monkeypatch.setattr(D, "SET", 300)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)
    assert sum(r.contaminated for r in got.collect()) >= 5


def test_a_row_group_is_one_block(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    docs = [*enumerate(texts(rnd, 120)), (120, "word " * 400)]
    items = [(i, docs[7 * i][1]) for i in range(10)]
    monkeypatch.setattr(D, "BLOCK", 300)
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), f"file://{tmp_path}/index")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert len(groups) == index.count() > 15 and {g.num_rows for g in groups} == {1}
    columns = [g.column(c) for g in groups for c in range(g.num_columns)]
    assert {c.has_dictionary_page for c in columns if c.path_in_schema in ("terms.list.element", "places.list.element")} == {False}
    assert D.documents_of(index).count() == len(docs)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def block(texts_):
    b = D._block(0, pa.array(range(len(texts_))), pa.array(texts_))
    return {c: b.column(c)[0].values for c in ("words", "terms", "count", "places")}


@pytest.mark.parametrize("slop", [0, 2, 6])
def test_proximity(slop):
    rnd = random.Random(slop)
    docs, items = texts(rnd, 40, 14, 40), texts(rnd, 12, 14, 6) + ["a b a", ""]
    p = D._Postings(block(docs), D._tests(pa.array(items), 4))
    window, slot, place = p.near(slop)
    got = {(int(p.tests.item[w]), int(p.tests.start[w]), int(s), int(x - p.begin[s])) for w, s, x in zip(window, slot, place, strict=True)}
    want, at = set(), 0
    for i, item in enumerate(items):
        v = words(item)
        k = min(len(v), 4)
        for j in range(len(v) - k + 1 if v else 0):
            for d, doc in enumerate(docs):
                w = words(doc)
                want |= {(i, at + j, d, s) for s in range(len(w)) if {*v[j : j + k]} <= {*w[s : s + k + slop]} and w[s] in v[j : j + k]}
        at += len(v)
    assert got == want and want


def test_proximity_rows(spark):
    index = D.build_index(spark.createDataFrame([(1, "x one gap two three y"), (2, "three two one"), (3, "one two")], "doc_id long, text string"))
    items = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    met = D.matches(index, items, 10, slop=1).join(D.documents_of(index), ["block", "slot"]).select("doc_id", "item_id", "begin", "n")
    assert sorted(map(tuple, met.collect())) == [(1, 7, 1, 4), (2, 7, 0, 4)]
    assert D.matches(index, items).count() == 0
