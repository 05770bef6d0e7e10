"""Words, streams and array rows made in batches, against plain loops and the window operators."""

import random
import re
from hashlib import md5

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linepack.operators import layout as L
from linepack.operators import metrics as G
from linepack.operators import streams as S
from linepack.operators import tokens as C
from linepack.plans import evaluation, layout
from linepack.plans._base import word_documents


def words_of(text):
    out = []
    for b in re.split(r"(?<=[\n\r])(?=[^\n\r])", text):
        run = re.search(r"[\n\r]*\Z", b).group(0)
        w = b[: len(b) - len(run)].split(" ")
        out.append([*w[:-1], w[-1] + run])
    return out


def texts(n, seed, letters="ab  \n\ré"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(12))) for _ in range(n)]


def test_words_equal_a_loop():
    for seed in range(300):
        t = texts(5, seed)
        got = S.split_words(pa.array(["zz", *t, "q"]).slice(1, len(t)))
        want = [words_of(x) for x in t]
        flat = [w.encode() for x in want for b in x for w in b]
        assert list(got.blocks) == [len(x) for x in want] and list(got.lens) == [len(b) for x in want for b in x] and got.words.to_pylist() == flat
        assert list(S.word_ids(got.words)) == [int(md5(w).hexdigest()[:7], 16) for w in flat]


def test_streams_equal_windows(spark, monkeypatch):
    rows = list(enumerate(texts(80, 5))) + [(80, None), (81, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    monkeypatch.setattr(S, "AT_ONCE", 20)
    own = ("depth_in_line", "line_start", "is_anchor_target")
    s = S.word_stream(df, "doc_id", "pos", "token", "target", "target_bytes", "is_newline", "line_at", *own).cache()
    assert {r.doc_id for r in s.collect()} == {i for i, t in rows if t is not None}
    for i, t in rows[:30]:
        flat = [w for b in words_of(t) for w in b]
        ids = [int(md5(w.encode()).hexdigest()[:7], 16) for w in flat]
        got = s.where(F.col("doc_id") == i).orderBy("pos").collect() if i < 3 else None
        if got:
            assert [r.token for r in got] == [1, *ids] and [r.target for r in got] == [*ids, 1] and [r.target_bytes for r in got] == [*(len(w.encode()) for w in flat), 0]
            assert [r.line_at for r in got] == [*(k for b in words_of(t) for k in range(len(b))), None]
    want = L.plain_slice_labels(s.drop(*own), "doc_id", 1)
    keys = ["doc_id", "pos", *own]
    assert sorted(map(tuple, s.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))
    w = S.word_stream(df, "doc_id", "pos", "token", "wave", bos=layout.MARKS["bos"], openers=layout.WAVES)
    width = F.create_map(*[F.lit(x) for pair in layout.WAVES.items() for x in pair])
    carried = L.carry_wave(w.drop("wave"), "doc_id", layout.MARKS["bos"], F.try_element_at(width, F.col("token")))
    assert sorted(map(tuple, w.select("doc_id", "pos", "wave").collect())) == sorted(map(tuple, carried.select("doc_id", "pos", "wave").collect()))
    arrays = {r.doc_id: list(r.target) for r in S.word_stream(df, "doc_id", "target", arrays=True).collect()}
    assert arrays[0] == [r.target for r in s.where("doc_id = 0").orderBy("pos").collect()]
    with pytest.raises(ValueError):
        S.word_stream(df, "doc_id", "nothing")


def test_array_rows_equal_windows(spark, sf, monkeypatch):
    monkeypatch.setattr(L, "AT_ONCE", 3000)
    docs = word_documents(spark, sf, ids=True).where("doc_id < 40")
    rows, pos = L.rows(docs, "doc_id", more=("segment",)), L.positions(docs, "doc_id").cache()
    for made, want in ((L.segments_of_rows(rows), L.row_segments(pos)), (L.lines_of_rows(rows), L.logical_lines(pos))):
        assert sorted(map(tuple, made.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    spans = pos.groupBy("doc_id").agg((F.max("row_pos") - 3).alias("start"), F.max("row_pos").alias("end"))
    want = {r.doc_id: (r.a, r.b) for r in G.row_records(pos, spans, "doc_id").groupBy("doc_id").agg(F.count_if("is_answer").alias("a"), F.count_if("predicts_answer").alias("b")).collect()}
    last = F.size("row_pos") - 1
    flags = [F.size(F.filter(x, lambda y: y)) for x in G.row_flags(F.col("row_pos"), last - 3, last)]
    assert {r[0]: (r[1], r[2]) for r in rows.select("doc_id", *flags).collect()} == want


def test_exact_match_equals_the_join(spark):
    items = [(0, 1, 4, [1, 2, 3], [1, 2, 3]), (1, 1, 4, [1, 2, 3], [1, 0, 3]), (2, 2, 3, [0, 2, 9], [1, 2, 3]), (3, 5, 6, [1], [1]), (4, 1, 3, [None, 2], [1, 2]), (5, 0, 3, [1, 2], [1, 2])]
    df = spark.createDataFrame(items, "item int, start int, end int, p array<int>, a array<int>")
    got = {r.item: r.c for r in df.select("item", G.exact_match(F.col("start"), F.col("end"), F.col("p"), F.col("a")).alias("c")).collect()}
    each = df.select("item", F.posexplode(F.arrays_zip("p", "a")).alias("pos", "x")).select("item", "pos", F.col("x.p").alias("predicted"), F.col("x.a").alias("actual"))
    want = {r.item: r.correct for r in G.score_exact(df.select("item", "start", "end"), each).collect()}
    assert {k: got[k] for k in want} == want and got[3] is None


def test_losses_of_rare_and_frequent_targets(spark, monkeypatch):
    """The same losses whichever way a target finds them; no window or join deals out a frequent target."""
    monkeypatch.setattr(evaluation, "OFTEN", 4)
    rows = [(5, 2)] * 9 + [(6, 3)] * 3 + [(7, 1), (8, 4), (1, 0), (1, 0), (7, 0)]
    made = evaluation._with_losses(spark.createDataFrame(rows, "target int, target_bytes int"))
    plain = spark.createDataFrame(rows, "target int, target_bytes int")
    c = plain.where("target_bytes > 0").groupBy("target").agg(F.count("*").alias("c"))
    want = plain.join(c, "target", "left").select("target", "target_bytes", F.coalesce(-F.log(F.col("c") / 14), F.lit(0.5)).alias("nats"))
    order = lambda x: sorted((r.target, r.target_bytes, round(r.nats, 12)) for r in x.collect())
    assert order(made) == order(want)
    assert "BroadcastHashJoin" in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["d17_row_segments", "d18_logical_lines", "g25_row_records", "g20_score_exact"])
def test_no_position_is_shuffled(spark, sf, name):
    query = {**layout.QUERIES, **evaluation.QUERIES}[name]
    assert "hashpartitioning" not in query(spark, sf)._jdf.queryExecution().toString()


def test_bytes_are_not_remembered():
    """Texts that are one word each, as in the vocabulary of bytes, are not kept from batch to batch; others are up to some room."""
    bytes_, merged = C._Encoder([]), C._Encoder([(97, 98, 256)])
    for encoder in (bytes_, merged):
        got = encoder.rows(pa.array([["ab", "é"], None, [], ["a" * 50]], pa.list_(pa.string())))
        assert got.to_pylist()[1:] == [[], [], [97] * 50]
    assert not bytes_.known and merged.held == 53
    merged.held = C.ROOM + 1
    merged.rows(pa.array([["b"]], pa.list_(pa.string())))
    assert set(merged.known) == {"b"}
