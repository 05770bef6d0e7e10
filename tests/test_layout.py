"""Golden layouts and a loop model of the schedule."""

import random

import pytest
from pyspark.sql import functions as F

from linepack.operators import layout as L

WARM, MIDDLE, TAIL = [[100]], [[200, 201, 202, 203], [210, 211, 212], [220, 221]], [300, 301]
GOLD = {
    2: ("1 100 2 200 2 201 210 202 211 203 212 2 220 2 221 5 300 301", "0 0 1 1 2 1 2 1 2 1 2 3 3 4 3 4 4 4", "0 1 0 1 0 2 1 3 2 4 3 0 1 0 2 1 2 3", "0 1 256 257 512 258 513 259 514 260 515 768 769 1024 770 1025 1026 1027", "100 3 200 201 210 202 211 203 212 3 3 220 221 5 3 300 301 1"),
    1: ("1 100 2 200 201 202 203 2 210 211 212 2 220 221 2 5 300 301", "0 0 1 1 1 1 1 2 2 2 2 3 3 3 4 4 4 4", None, None, None),
    None: ("1 100 2 200 2 201 210 2 202 211 220 2 203 212 221 5 300 301", "0 0 1 1 2 1 2 3 1 2 3 4 1 2 3 4 4 4", "0 1 0 1 0 2 1 0 3 2 1 0 4 3 2 1 2 3", "0 1 256 257 512 258 513 768 259 514 769 1024 260 515 770 1025 1026 1027", "100 3 200 201 210 202 211 220 203 212 221 5 3 3 3 300 301 1"),
}


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, blocks array<array<int>>, warm int")
    df = df.withColumn("lens", F.transform("blocks", lambda b: F.size(b)))
    n = F.size("blocks")
    return df.withColumn("n_blocks", n).withColumn("has_tail", n >= 2).withColumn("n_warm", F.col("warm")).withColumn("n_middle", n - F.col("warm") - (n >= 2).cast("int"))


@pytest.mark.parametrize("cap", [1, 2, 4, None])
def test_golden_rows(spark, cap):
    rows = L.positions(docs(spark, [(0, WARM + MIDDLE + [TAIL], 1)]), "doc_id", cap=cap).orderBy("row_pos").collect()
    for name, want in zip(("token", "thread", "local_step", "rope", "target"), GOLD[None if cap == 4 else cap]):
        if want:
            assert [r[name] for r in rows] == [int(x) for x in want.split()]


def slow_positions(lens, warm, cap):
    """Step by step: at most one start a step, and only while fewer than the cap are active."""
    out = [(0, t, j, t) for t in range(warm) for j in range(lens[t] + 1)]
    tail = len(lens) - 1 if len(lens) > 1 else None
    waiting, active, step = [t for t in range(warm, len(lens)) if t != tail], {}, 0
    mid, rows, candidate = list(waiting), [], tail is not None
    while waiting or active or candidate:
        free = cap is None or len(active) < cap
        for t in sorted(active):
            rows.append((t, active[t]))
            active[t] += 1
        if free and waiting:
            t = waiting.pop(0)
            rows.append((t, 0))
            active[t] = 1
        elif free and candidate:
            rows.append((tail, 0))
            candidate = False
        active = {t: j for t, j in active.items() if j <= lens[t]}
        step += 1
    order = [(t, j) for _, t, j, _ in out] + rows
    return order + ([(tail, j) for j in range(1, lens[tail] + 2)] if tail is not None else []), mid


@pytest.mark.parametrize("cap", [1, 2, 3, None])
def test_random_rows_equal_the_loop(spark, cap):
    rnd = random.Random(cap or 9)
    made = []
    for i in range(60):
        lens = [rnd.randrange(1, 7) for _ in range(rnd.randrange(1, 9))]
        made.append((i, [[1000 + k] * n for k, n in enumerate(lens)], rnd.randrange(1, max(2, len(lens)))))
    df = docs(spark, made)
    got = {}
    for r in L.positions(df, "doc_id", cap=cap).orderBy("doc_id", "row_pos").collect():
        got.setdefault(r.doc_id, []).append((r.thread, r.local_step))
    steps = {r.doc_id: (r.n, r.s, r.g) for r in df.join(L.step_groups(L.positions(df, "doc_id", cap=cap), "doc_id").groupBy("doc_id").agg(F.count("*").alias("g")), "doc_id").select("doc_id", L.row_length().alias("n"), L.step_count(cap).alias("s"), "g").collect()}
    for i, blocks, warm in made:
        want, _ = slow_positions([len(b) for b in blocks], warm, cap)
        assert got[i] == want
        assert steps[i][0] == len(want) and steps[i][1] == steps[i][2]


def test_blocks_by_class_and_odd_texts(spark):
    from linepack.functions.text import blocks, word_blocks

    rows = [(i, t) for i, t in enumerate(["\n\na", "a\n\n\nb", "a\r\n\r\nb", "a" + "\n" * 40, "one block", "", None])]
    df = spark.createDataFrame(rows, "doc_id int, t string")
    got = {r.doc_id: r.b for r in df.select("doc_id", blocks(F.col("t")).alias("b")).collect()}
    assert got[0] == ["\n\n", "a"] and got[1] == ["a\n\n\n", "b"] and got[2] == ["a\r\n\r\n", "b"] and got[3] == ["a" + "\n" * 40] and got[6] is None
    assert all(r.s == r.t for r in df.where("t is not null").select("t", F.array_join(F.flatten(F.transform(word_blocks(F.col("t")), lambda w: F.array(F.array_join(w, " ")))), "").alias("s")).collect())
    cls = spark.createDataFrame([(["A", "N", "N", "B", "T", "N", "C", "T", "T", "D"], ["NO", "PURE", "PURE", "NO", "TRAIL", "PURE", "NO", "TRAIL", "TRAIL", "NO"])], "t array<string>, c array<string>")
    ids = cls.select(L.split_blocks_by_class(F.transform("t", lambda x: F.ascii(x)), F.col("c")).alias("b")).first().b
    assert ["".join(map(chr, b)) for b in ids] == ["ANN", "BTN", "CT", "T", "D"]


@pytest.mark.parametrize("cap", [2, None])
def test_labels_in_the_batch_equal_windows_over_positions(spark, cap):
    rnd = random.Random(12)
    made = [(i, [[rnd.randrange(50, 90) for _ in range(rnd.randrange(1, 6))] for _ in range(rnd.randrange(1, 9))], 0) for i in range(40)] + [(40, [[7]], 0), (41, [], 0)]
    df = L.assign_roles(docs(spark, made).drop("n_warm", "n_middle", "has_tail", "n_blocks"), 3).repartition(3)
    p = L.positions(df, "doc_id", cap=cap, more=L.MORE).cache()
    plain = L.positions(df, "doc_id", cap=cap)
    keys = ["doc_id", "row_pos"]
    for names, made_by in ((("next_pos",), L.next_in_thread(plain)), (L.LABELS, L.slice_labels(plain)), (("source_index", "target_row"), L.position_labels(plain)), (("gen_step",), L.generation_steps(plain))):
        rows = [sorted(map(tuple, x.select(*keys, *names).collect())) for x in (p, made_by)]
        assert rows[0] == rows[1] and rows[0]
    spans = p.groupBy("doc_id", "segment").agg(F.min("row_pos").alias("first_pos"), F.max("row_pos").alias("last_pos")).select("doc_id", "segment", "first_pos", "last_pos")
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, L.row_segments(plain).select("doc_id", "segment", "first_pos", "last_pos").collect()))
    with pytest.raises(ValueError):
        L.positions(df, "doc_id", more=("nothing",))


def test_payloads_go_with_their_tokens_and_arrays_equal_rows(spark):
    made = [(0, WARM + MIDDLE + [TAIL], 1), (1, [[5, 6]], 1), (2, [[1], [2]], 1)]
    df = docs(spark, made).withColumn("twice", F.transform("blocks", lambda b: F.transform(b, lambda x: x * 2)))
    rows = L.positions(df, "doc_id", payloads=("twice",)).collect()
    anchors = [r for r in rows if r.local_step == 0 or r.token == 5 and r.local_step == 1 and r.doc_id != 1]
    assert all(r.twice is None for r in anchors) and all(r.twice == 2 * r.token for r in rows if r not in anchors)
    for r in L.rows(df, "doc_id", payloads=("twice",)).collect():
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.row_pos)
        assert all(list(r[c]) == [x[c] for x in own] for c in ("row_pos", "token", "target", "rope", "thread", "twice"))


def test_blocks_by_class(spark):
    rows = [(["NO", "NO"], [2]), (["TRAIL", "PURE", "PURE", "NO", "NO", "TRAIL", "TRAIL", "NO"], [3, 3, 1, 1]), (["PURE", "PURE", "NO"], [2, 1]), ([], []), (["TRAIL"], [1]), (["NO", "PURE", "NO", "PURE"], [2, 2])]
    df = spark.createDataFrame([(i, list(range(len(c))), c) for i, (c, _) in enumerate(rows)], "i int, t array<int>, c array<string>")
    for r in df.select("i", "t", L.split_blocks_by_class(F.col("t"), F.col("c")).alias("b")).collect():
        assert [len(x) for x in r.b] == rows[r.i][1] and [y for x in r.b for y in x] == r.t
