"""Source divergence against plain sums, and trees with shared nodes against whole rows of counts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linepack.llm import divergence as V


def plain(rows, least=3, ranks=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs, counts = defaultdict(lambda: defaultdict(set)), defaultdict(Counter)
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        counts[lang, source].update({})
        for t in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower()):
            docs[lang][t].add(k)
            counts[lang, source][t] += 1
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, of in docs[lang].items() if len(of) >= least]
        every = Counter()
        for (x, _), c in counts.items():
            every.update(c if x == lang else {})

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for (x, s), c in counts.items() if x == lang}, share(every)
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t.decode(), (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def test_odd_rows(spark):
    rows = [("one two two", "en", "a"), ("One, two.", "en", "b"), ("one TWO 3 three", "en", "a"), (None, None, None), ("", None, "a"), ("x", "", "c"), ("é É é日本", "xx", "a"), ("é", "xx", "a"), ("é z", "xx", "b"), ("z é", "xx", None),
            ("only digits 1 2", "de", "solo"), ("one", "en", "b"), ("one", "en", "b"), ("word " * 30_000, "en", "long"), ("two", "en", "a:b"), ("1 2 3", "en", "bare")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n int, term int")
    assert sorted(map(tuple, V.audit(df.repartition(3)).collect())) == plain(rows)
    assert sorted(map(tuple, V.audit(df, 1, 2).collect())) == plain(rows, 1, 2)
    assert V.audit(df.limit(0)).count() == 0


def test_more_sources_than_a_block_holds(spark):
    rng = np.random.default_rng(4)
    rows = [(" ".join(f"t{chr(97 + int(x))}" for x in rng.geometric(0.2, 12) % 26), "en", f"s{k % 70}") for k in range(400)]
    assert sorted(map(tuple, V.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect())) == plain(rows)


@pytest.mark.parametrize("sources,terms", [(2, 1), (3, 5), (4, 64), (6, 200)])
def test_walk_gives_every_pair_of_counts_once(sources, terms):
    counts = np.random.default_rng(terms).geometric(0.6, (sources, terms)) - 1
    forest = V.Forest(counts)
    a, b = (x.astype(np.int64) for x in np.triu_indices(sources, 1))
    pair, x, y, times = forest.leaf_pairs(a, b)
    got = {(int(i), int(p), int(q)): int(n) for i, p, q, n in zip(pair, x, y, times, strict=True)}
    want = Counter((i, int(p), int(q)) for i, (s, t) in enumerate(zip(a, b, strict=True)) for p, q in zip(counts[s], counts[t], strict=True))
    assert got == dict(want) and len(got) == len(pair)


def test_equal_subtrees_are_one_node():
    counts = np.tile(np.array([[0, 1, 0, 0], [0, 0, 0, 0]]), (1, 256))
    forest = V.Forest(counts)
    assert [len(left) for left, _ in forest.levels[1:]] == [2] * 9 and len(forest.levels[0][0]) == 2
    assert len(forest.leaf_pairs(np.array([0]), np.array([1]))[0]) == 2


def test_shares_do_not_overflow(spark):
    rows = [(0, 1, 1), (999, 1000, 7), (4 * 10**15, 5 * 10**15, 10**6), (5 * 10**15, 5 * 10**15, 1)]
    df = spark.createDataFrame(rows, "n long, total long, kept long")
    want = [1 + 1_000_000_000 * (n + 1) // (t + k) for n, t, k in rows]
    from pyspark.sql import functions as F

    assert [r.p for r in df.select(V._share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()] == want
    n, t, k = (np.array(x) for x in zip(*rows, strict=True))
    assert V._shares(n, t + k).tolist() == want
