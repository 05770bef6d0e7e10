"""Language ID, quality, WARC and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from linepack.llm import language, quality, queries, warc
from linepack.llm._common import drawn

PAGES = "page_id long, url string, html string, digest string, top long, value string"


def test_op5_finds_the_language_of_the_path(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("want"))
    rows = got.join(pages, "page_id").collect()
    assert len(rows) == pages.count()
    told = [r for r in rows if r.want]
    assert np.mean([r.lang == r.want for r in told]) > 0.97
    assert all(0 < r.posterior <= 1 for r in rows)


def test_fusion_equals_brute_force(spark):
    rnd = random.Random(1)
    model = language.TextModel(("aa", "bb"), np.log(np.random.default_rng(0).dirichlet(np.full(language.BUCKETS, 0.3), 3).T + 1e-12).astype(np.float32))
    rows = [(i, " ".join("".join(rnd.choice("abcd") for _ in range(4)) for _ in range(rnd.randrange(6))) or None, rnd.choice(["aa", "BB", "zz", None]), rnd.choice(["x", "y", None]), f"h{rnd.randrange(4)}" if rnd.random() < 0.9 else None, rnd.choice(["d0", "d1"])) for i in range(60)]
    rows = [(a, b, c, d, e, f if e else None) for a, b, c, d, e, f in rows]
    got = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string"), model).collect()}
    e = [language.evidence(model, r[1] or "") for r in rows]
    prior = np.log([0.4995, 0.4995, 0.001])
    p = [np.exp(x + prior) / np.exp(x + prior).sum() for x in e]
    total, host_weight, smoothing = sum(p), 20.0, 5.0
    overall = (total + 1) / (total.sum() + 3)

    def value(r, k):
        return {"aa": "aa", "bb": "bb"}.get((r[2] or "").lower(), "?" if r[2] else None) if k == 2 else r[k]

    kinds = {k: len({value(r, k) for r in rows} - {None}) + 1 for k in (2, 3)}
    for i, r in enumerate(rows):
        logs = e[i].copy()
        for k in (2, 3):
            if value(r, k) is not None:
                same = sum(p[j] for j, x in enumerate(rows) if value(x, k) == value(r, k)) - p[i]
                logs += np.log((np.maximum(same, 0) + smoothing / kinds[k]) / (total + smoothing))
        domain = host = np.zeros(3)
        if r[5] is not None:
            domain = sum(p[j] for j, x in enumerate(rows) if x[5] == r[5]) - p[i]
            host = sum(p[j] for j, x in enumerate(rows) if x[4] == r[4]) - p[i]
        domain, host = np.maximum(domain, 0), np.maximum(host, 0)
        up = (domain + host_weight * overall) / (domain.sum() + host_weight)
        logs += np.log((host + host_weight * up) / (host.sum() + host_weight))
        post = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[i].posterior == pytest.approx(post.max(), rel=1e-6) and got[i].lang == ("aa", "bb", "und")[int(post.argmax())]


def test_language_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit_text_model(docs)
    assert set(model.langs) <= {"en", "fr", "de", "es"} and "en" in model.langs
    rows = [(1, "http://a.example.de/x", None, "d", 1, "v"), (2, None, "", "d", 1, "v"), (None, "not a url", "<html lang='xx'><p>the and of</p>", None, None, None), (4, "https://10.0.0.1:80/", "<p>" + "the of and " * 50000, "d", 1, "v"), (4, "https://10.0.0.1:80/", "<script>x", "d", 1, "v")]
    got = language.identify_pages(spark.createDataFrame(rows, PAGES), model).collect()
    assert len(got) == 5 and all(r.lang for r in got)
    assert language.identify_pages(spark.createDataFrame([], PAGES), model).collect() == []
    empty = language.fit_text_model(docs.limit(0))
    assert {r.lang for r in language.identify_pages(spark.createDataFrame(rows, PAGES), empty).collect()} == {"und"}
    noise = " ".join("".join(random.Random(k).choice("qxzjkvw") for _ in range(9)) for k in range(80))
    more = [(5000, noise, "en", "s", 3, "k"), (6, None, "en", None, None, "k"), (7, "", None, None, None, "k"), (None, "the of and with this that", None, None, None, "k")]
    odd = docs.limit(30).withColumn("key", F.lit("k")).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, key string"))
    kept = language.keep_languages(odd, model)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([r.doc_id for r in docs.limit(30).collect()] + [None])


def test_visible_text():
    page = "<!DOCTYPE html><html lang=en><head><style>p{}</style><script>var t=\"</p>\";</script></head><!-- x --><body><p>a &amp; b<br>c</body>"
    assert language.visible_text(page).split() == ["a", "&", "b", "c"]


def slow_marginals(emit, pairs):
    z, good = 0.0, np.zeros(len(emit))
    for y in itertools.product((0, 1), repeat=len(emit)):
        w = np.exp(sum(e for e, v in zip(emit, y) if v) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
        z += w
        good += w * np.array(y)
    return good / z


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 7, 2, 7])
    emit, pairs = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    good, expected = quality.marginals(emit, pairs, starts, counts)
    for s, n in zip(starts, counts):
        assert np.allclose(good[s : s + n], slow_marginals(emit[s : s + n], pairs))
    assert expected.sum() == pytest.approx((counts - 1).sum())


def test_op8_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    told = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in told]) > 0.95


def test_op8_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.createDataFrame([(i, q, 0) for i, q in [(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (999999, 1), (5, 1), (6, 0), (8, 1), (9, 0)]], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, " \n\n ", None), (3, "x" * 200000, 1.0), (3, "word\n" * 50000, 1.0), (3, "word\n" * 50000, 1.0)], "doc_id long, text string, score double")
    rows = quality.score_documents(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(odd.limit(0), model).collect() == []
    assert quality.keep_good(odd, model).columns == odd.columns
    none = quality.fit(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in quality.score_documents(odd, none).collect())


def test_op9_equals_definition(spark, sf):
    rows = queries.op9_warc(spark, sf).collect()
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert Counter(r.page_id for r in rows) == Counter(list(pages))
    top = {h: max(i for i, x in pages.items() if x == h) for h in pages.values()}
    for r in rows:
        h = pages[r.page_id]
        last = top[h]
        want = (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if r.page_id == last else "revisit", None if r.page_id == last else last)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_op9_odd_rows_and_round_trip(spark, tmp_path):
    big = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=100_000)) * 180  # a record of over 16 MB
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "alone"), (None, "u", "same"), (6, "u", big), (7, "u", "ÿ" * 3000), (3, None, "same")]
    df = spark.createDataFrame([(*r, "d", 1, "v") for r in rows], PAGES)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, archive=600)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None), (4, "revisit", 5), (5, "response", None), (None, "response", None), (None, "revisit", 3), (6, "response", None), (7, "response", None)])
    html = {r[0]: (r[2] or "").encode() for r in rows if r[0]}
    for r in got:
        if r.page_id and r.record_type == "response":
            assert bytes(r.payload) == html[r.page_id] and r.payload_bytes == len(html[r.page_id])
    raw = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert sum(gzip.decompress(x).count(b"WARC/1.1\r\n") for x in raw) == len(rows)  # plain gzip files
    warc.write_archives(df.where("page_id in (1, 2, 4)"), path + "2", least_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, path + "2").collect()} == {"response"}
    warc.write_archives(df.limit(0), path + "3")
    assert warc.read_archives(spark, path + "3").collect() == []


def test_reader_finds_damage():
    data = warc._member(warc.record(1, "http://a/", b"payload" * 1000, None, False, warc.base32_sha1(b"payload" * 1000)))
    for step in (1, 7, 65536):
        (r,) = warc.read_records([data[k : k + step] for k in range(0, len(data), step)], True)
        assert r["payload"] == b"payload" * 1000
    plain = gzip.decompress(data)
    for bad in (plain.replace(b"payloadpayload", b"payloadPayload", 1), plain[:-4], plain.replace(b"Content-Length: 7000", b"Content-Length: 7001"), b"hello\r\n\r\n"):
        with pytest.raises((warc.WarcError, KeyError)):
            list(warc.read_records([warc._member(bad)]))
    with pytest.raises(warc.WarcError):
        list(warc.read_records([data[:-30]]))


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    step = docs
    for name, stage in cp.STAGES[:-1]:
        step = stage(spark, step, sf).cache()
        assert step.columns == docs.columns
        left = {r.doc_id: r.text for r in step.collect()}
        assert left.items() <= before.items()
        gone = set(before) - set(left)
        if name == "language ID":
            assert len(gone) <= 5
        elif name == "quality classifier":
            bad = {i for i in before if quality_of.get(i) == 0}
            good = {i for i in before if quality_of.get(i) == 1}
            assert len(gone & bad) >= 0.9 * len(bad) and len(gone & good) <= 0.01 * len(good) + 1
        else:
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in before.items())}
            ids, up = sorted(before), {i: i for i in before}

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in itertools.combinations(ids, 2):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
            assert set(left) == {i for i in ids if find(i) == i}
        before = left
    rows = cp.STAGES[-1][1](spark, step, sf).collect()
    assert {r.doc_id for r in rows} == set(before)


def test_samples_of_very_large_tables_are_not_empty(spark):
    share = F.lit(4000 / 1e10)
    n = spark.range(50_000_000).where(drawn("id", 17, share)).count()
    assert 3 <= n <= 60  # 20 are expected
    assert spark.range(1000).where(drawn("id", 17, F.lit(1.0))).count() == 1000 and spark.range(1000).where(drawn("id", 17, F.lit(0.0))).count() == 0


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(3 * k + j, "some words of a text", f"l{k}") for k in range(4) for j in range(3)], "doc_id long, text string, lang string")
    assert len(language.fit_text_model(docs).langs) == 4
    with pytest.raises(ValueError, match="more than 3"):
        language.fit_text_model(docs, most=3)


def test_training_lines_of_a_document_are_bounded(spark):
    docs = spark.createDataFrame([(k, "\n".join([f"A plain line number {j}." if k % 2 else "BUY NOW!!! $$$ | | |" for j in range(300)])) for k in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    model = quality.fit(docs, labels, most_lines=20)
    rows = quality.score_documents(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_archives_are_closed_by_bytes(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, "http://a/", rnd.randbytes(rnd.choice([100, 3000, 40_000])).hex()) for k in range(120)]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, archive=100_000)
    sizes = [p.stat().st_size for p in (tmp_path / "warc").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 100_000 + 90_000
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert {r.page_id: r.payload.decode() for r in got} == {k: h for k, _, h in rows}
