"""The near-dedup stage of the pipeline: nothing that is alike and shares a bucket is lost."""

import random
from collections import defaultdict

import numpy as np
import pytest

from linepack.llm import graph, simhash


def groups(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                up[find(a)] = find(b)
    out = defaultdict(set)
    for x in range(n):
        out[find(x)].add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("bucket", [1, 2, 7, 1024])
def test_links_of_a_bucket_hold_and_keep_components(spark, bucket):
    rnd = random.Random(5)
    sets = []
    for _ in range(5):  # a hub at 0.75 of all its edits, which are alike in twos
        hub = rnd.sample(range(1 << 32), 100)
        sets.append(hub)
        for _ in range(6):
            edit = hub[:86] + rnd.sample(range(1 << 32), 14)
            sets += [edit, [*edit[:-3], *rnd.sample(range(1 << 32), 3)]]
    rnd.shuffle(sets)
    like = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8
    rows = spark.createDataFrame([(1, i, len(sets)) for i in range(len(sets))] + [(2, 0, 2), (2, 1, 2)], "key long, node long, n long")
    bodies = spark.createDataFrame([(i, bytearray(np.unique(np.array(x, np.uint32)).tobytes())) for i, x in enumerate(sets)], "node long, `set` binary")
    found = simhash.alike_links(rows, bodies, 0.8, bucket)
    assert all(like(r.a, r.b) for r in found.collect())
    root = {r.node: r.root for r in graph.components(found).collect()}
    got = defaultdict(set)
    for i in range(len(sets)):
        got[root.get(i, i)].add(i)
    want = groups(len(sets), like)
    assert max(map(len, want)) > 1 and sorted(map(sorted, got.values())) == want


def test_near_copies_behind_a_common_hub_are_found(spark):
    rnd = random.Random(6)
    rows = []
    for g in range(40):  # the same long words, so equal fingerprints: the hub in another order, the two others alike
        text = [f"word{g}x{k}" for k in range(60)]
        hub = rnd.sample(text, len(text))
        near = [*text[:30], "a", *text[30:]]
        for k, t in enumerate(rnd.sample([hub, text, near], 3)):
            rows.append((10 * g + k, " ".join(t)))
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept == 80


def test_recall_by_band_on_planted_pairs(spark):
    """Pairs of similarity 0.8 to 1 by words replaced, passages added and removed, in short and long texts."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10)))
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, bands = [], defaultdict(list)
    while min((len(bands[k]) for k in (80, 85, 90, 95)), default=0) < 60:
        text = [word() for _ in range(rnd.choice([40, 100, 400]))]
        n, edit = len(text), list(text)
        part, at = max(1, int(n * rnd.uniform(0.01, 0.2))), rnd.randrange(n)
        match rnd.randrange(3):
            case 0:
                for _ in range(max(1, part // 5)):
                    edit[rnd.randrange(n)] = word()
            case 1:
                edit[at:at] = [word() for _ in range(part)]
            case 2:
                del edit[at : at + part]
        x, y = shingles(text), shingles(edit)
        s = len(x & y) / len(x | y)
        if 0.8 <= s < 1 and len(bands[k := int(s * 20) * 5]) < 60:
            bands[k].append(len(rows))
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edit))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    recall = {k: np.mean([i + 1 not in kept for i in v]) for k, v in sorted(bands.items())}
    print("recall by band:", recall)
    assert min(recall.values()) >= 0.9 and all(i in kept for v in bands.values() for i in v)


def test_pairs_across_any_number_of_long_words(spark):
    """Texts of short words with 6 to 10 long ones and a copy with one or two of these replaced: one rule holds for all."""
    rnd = random.Random(9)
    rows = []
    for g in range(60):
        short = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(144)]
        text = short + [f"longword{g}x{k}" for k in range(6 + g % 5)]
        rnd.shuffle(text)
        at = next(k for k, w in enumerate(text) if len(w) > 4)
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join([*text[:at], "tiny", *text[at + 1 :]]))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == {2 * g for g in range(60)}


@pytest.mark.parametrize("crowd,trials", [(0, 20), (64, 20), (5000, 4)])
def test_a_pair_in_a_crowded_bucket_is_found(spark, crowd, trials):
    """Rows that share a pair's key by chance, and come before it, hide it in no trial; none of them is linked."""
    rng, (n, bits) = np.random.default_rng(crowd), simhash.shape(1)
    tables, full = simhash.masks(simhash.RADIUS, bits), (1 << bits) - 1
    rows, pairs = [], []

    def add(fps, check):
        rows.append((len(rows), [int(x) for x in fps], [int(np.uint64(x).view(np.int64)) for x in check]))
        return len(rows) - 1

    def flipped(words_, width):
        flips = [sum(1 << i for i in range(width) if rng.random() < simhash.DIFFER) for _ in words_]
        return [int(w) ^ f for w, f in zip(words_, flips, strict=True)]

    draw = lambda k, most: [int(x) for x in rng.integers(0, most, k, dtype=np.uint64, endpoint=True)]
    for t in range(trials):
        mask, fps, check = tables[t % len(tables)], draw(n, full), draw(simhash.CHECKS, (1 << 64) - 1)
        for _ in range(crowd):
            other = draw(n, full)
            other[0] = other[0] & ~mask | fps[0] & mask
            add(other, draw(simhash.CHECKS, (1 << 64) - 1))
        like = flipped(fps, bits)
        like[0] = like[0] & ~mask | fps[0] & mask
        pairs.append((add(fps, check), add(like, flipped(check, 64))))
    nodes = spark.createDataFrame(rows, "node long, fps array<long>, `check` array<long>").repartition(4)
    most = int(simhash.APART * (bits + simhash.CHECKS * simhash.BITS))
    root = {r.node: r.root for r in graph.components(simhash.links(nodes, simhash.RADIUS, bits=bits, most=most)).collect()}
    assert sorted(root) == sorted(x for pair in pairs for x in pair) and all(root[a] == root[b] for a, b in pairs)


def test_texts_of_one_template(spark):
    """Documents that share two thirds of their shingles crowd all buckets; those alike among them are found."""
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    head = [word() for _ in range(120)]
    rows = []
    for _ in range(150):
        own = [word() for _ in range(60)]
        rows += [" ".join([*head, *own]), " ".join([*head, *own[:58], word(), word()])]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert kept == set(range(0, 300, 2))


def test_fingerprints_grow_with_the_rows():
    shapes = [simhash.shape(n) for n in (0, 10**4, 10**6, 10**8, 10**9, 10**10)]
    assert shapes[0] == shapes[1] == (10, 32) and shapes == sorted(shapes) and shapes[-1][1] > 45
    rng = np.random.default_rng(1)  # the rule behind them, against drawn pairs
    for bits in (32, 48):
        tables = np.array(simhash.masks(3, bits), np.uint64)
        apart = np.array([sum(1 << i for i in np.flatnonzero(rng.random(bits) < 0.15).tolist()) for _ in range(4000)], np.uint64)
        assert abs(((apart[:, None] & tables) == 0).any(1).mean() - simhash.offered(bits)) < 0.06
