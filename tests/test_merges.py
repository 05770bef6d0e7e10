"""Many merges a round against one merge at a time, with and without protected newlines; encoding by distinct words."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linepack.operators import merges as M
from linepack.operators import tokens as C
from linepack.operators.ranks import rank_rows


def naive(words, most, protect):
    classes, out = M.byte_classes() if protect else None, []
    state = [(n, list(w.encode())) for w, n in words]
    while len(out) < most:
        pairs = Counter()
        for n, s in state:
            for a, b in zip(s, s[1:], strict=False):
                if classes is None or M.joined_class(classes[a], classes[b]) != M.INVALID:
                    pairs[a, b] += n
        if not pairs:
            break
        (a, b), _ = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((a, b, 256 + len(out)))
        if classes is not None:
            classes.append(M.joined_class(classes[a], classes[b]))
        for _, s in state:
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [out[-1][2]]
                i += 1
    return out


def rounds(words, most, protect, candidates):
    """The learner's rounds without Spark."""
    classes, out = M.byte_classes() if protect else None, []
    rows = [(n, list(w.encode())) for w, n in words if len(w.encode()) > 1]
    state = pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.int32()))], names=["n", "s"])
    while len(out) < most and state.num_rows:
        found = next(M._pair_counts(None if classes is None else np.array(classes))(iter([state])))
        top = sorted(((n, a, b) for a, b, n in zip(*(x.to_pylist() for x in found.columns), strict=True)), key=lambda x: (-x[0], *x[1:]))
        if not top:
            break
        wanted = [(a, b) for _, a, b in top[:candidates] if a != b]
        near = {p: ({}, {}) for p in wanted}
        if wanted:
            for p, side, other, n in zip(*(x.to_pylist() for x in next(M._contexts(wanted)(iter([state]))).columns), strict=True):
                near[wanted[p]][side][other] = n
        taken = M.Replay(top[:candidates], len(top) > candidates, near, classes).merges(256 + len(out), most - len(out))
        assert taken
        out += taken
        state = next(M._rewritten(taken)(iter([state])))
    return out


@pytest.mark.parametrize("protect", [False, True])
def test_rounds_equal_one_merge_at_a_time(protect):
    rnd = random.Random(protect)
    for trial in range(150):
        letters = ["ab", "ab\n", "abcdefg\n"][trial % 3]
        words = list(Counter("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))) for _ in range(rnd.randrange(3, 80))).items())
        most = rnd.choice([5, 30, 100])
        assert rounds(words, most, protect, rnd.choice([1, 3, 10, 50])) == naive(words, most, protect)


def test_learner_on_the_cluster(spark, sf):
    words = C.word_counts(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40"), C.pretokenize(F.col("text")))
    rows = [tuple(r) for r in words.collect()]
    assert M.train_bpe(words, 120, candidates=64, cut_every=2, protect_newlines=True) == naive(rows, 120, True)
    assert M.train_bpe(words.limit(0), 5) == [] and M.train_bpe(spark.createDataFrame([("ab", 1)], "word string, n long"), 5) == [(97, 98, 256)]


def test_no_learned_token_breaks_lines(spark):
    rnd = random.Random(8)
    words = [("".join(rnd.choice("ab\n\r") for _ in range(6)), rnd.randrange(1, 9)) for _ in range(300)]
    df = spark.createDataFrame([(w, n) for w, n in dict(words).items()], "word string, n long")
    free, kept = M.train_bpe(df, 60), M.train_bpe(df, 60, protect_newlines=True)
    C.check_vocab(C.merged_vocab(spark, kept, ["<|bos|>"]))
    with pytest.raises(ValueError, match="newlines inside"):
        C.check_vocab(C.merged_vocab(spark, free, ["<|bos|>"]))


def test_encoding_gathers_what_each_word_gives(spark):
    rnd = random.Random(9)
    texts = [(i, ["".join(rnd.choice("abc é") for _ in range(rnd.randrange(7))) for _ in range(rnd.randrange(30))]) for i in range(50)] + [(50, None), (51, []), (52, [""])]
    merges = naive([(w, 1) for _, t in texts for w in t or []], 25, False)

    def ids(word):
        s = list(word.encode())
        for a, b, new in merges:
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [new]
                i += 1
        return s

    df = spark.createDataFrame(texts, "doc_id int, w array<string>").repartition(3)
    want = {i: [x for w in t or [] for x in ids(w)] for i, t in texts}
    assert {r.doc_id: list(r.ids) for r in C.encode(df, F.col("w"), merges).collect()} == want
    assert {r.doc_id: list(r.ids) for r in C.encode(df, F.col("w"), merges, first=7, backwards=True).collect()} == {i: [7, *x[::-1]] for i, x in want.items()}
    back = C.decode(C.encode(df, F.col("w"), merges), merges).collect()
    assert {r.doc_id: r.decoded for r in back} == {i: "".join(t or []) for i, t in texts}


def test_ranks(spark):
    rows = [(i * 7919 % 501, f"x{i % 5}") for i in range(501)]
    got = rank_rows(spark.createDataFrame(rows, "a int, b string").repartition(7), F.desc("b"), "a").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda x: (-int(x[1][1:]), x[0])) and sorted(r["rank"] for r in got) == list(range(501))


def test_token_blocks_equal_the_array_form(spark, tmp_path):
    from linepack.operators import layout as L

    rnd = random.Random(11)
    merges = [(97, 10, 256), (10, 10, 257), (256, 257, 258), (98, 98, 259)]
    M.write_merges(spark, merges, f"file://{tmp_path}/m")
    assert M.read_merges(spark, f"file://{tmp_path}/m") == merges
    classes = M.token_classes(merges)
    assert classes[256:] == [M.TRAIL, M.PURE, M.TRAIL, M.NO]
    rows = [(i, [rnd.choice([97, 98, 10, 13, 256, 257, 258, 259, 999]) for _ in range(rnd.randrange(12))]) for i in range(200)] + [(200, None), (None, [10])]
    df = spark.createDataFrame(rows, "doc_id int, ids array<int>").repartition(3)
    names = {M.NO: "NO", M.PURE: "PURE", M.TRAIL: "TRAIL"}
    kinds = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (i, names[c])])
    plain = df.where("ids is not null").select("doc_id", L.split_blocks_by_class(F.col("ids"), F.transform("ids", lambda i: F.coalesce(kinds[i], F.lit("NO")))).alias("blocks"))
    want = {r.doc_id: r.blocks for r in plain.collect()} | {200: []}
    got = L.token_blocks(df, classes).collect()
    assert {r.doc_id: r.blocks for r in got} == want and all(r.lens == [len(b) for b in r.blocks] for r in got)


def test_a_round_goes_over_the_words_once(spark, monkeypatch):
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 9))): rnd.randrange(1, 60) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    passes, made = [], M._round
    monkeypatch.setattr(M, "_round", lambda merges, *rest: (passes.append(len(merges)), made(merges, *rest))[1])
    merges = M.train_bpe(df, 12, candidates=32)
    assert merges == naive(list(words.items()), 12, False)
    assert len(passes) - 1 == sum(n > 0 for n in passes) + 1  # the first round alone asks for neighbours in a second pass
