"""Assembled rows, and turn documents with masks, against plain lists."""

import random

import pytest
from pyspark.sql import functions as F

from linepack.operators import chat, layout, packing


@pytest.mark.parametrize("count_on", [False, True])
def test_rows_equal_lists(spark, count_on):
    rnd, capacity, stride = random.Random(3), 40, 8
    docs = []
    for i in range(200):
        n = rnd.choice([1, 3, 7, 20, 40, 41])
        docs.append((i, f"s{i % 3}", n, [rnd.randrange(100) for _ in range(n)], [rnd.randrange(30) for _ in range(n)]))
    df = spark.createDataFrame(docs, "doc_id int, shard string, length int, token array<int>, rope array<int>").repartition(5)
    packed = packing.pack_whole(df, capacity, "shard")
    got = packing.assemble_rows(packed, df, capacity, "shard", "doc_id", {"token": -7, "rope": 0}, stride=stride, count_on=count_on)
    places, want = {}, {}
    for p in packed.collect():
        places.setdefault((p.shard, p.row), []).append((p.offset, p.doc_id))
    assert sum(map(len, places.values())) == sum(d[2] <= capacity for d in docs)
    for at, of in places.items():
        tokens, rope, cursor = [], [], 0
        for offset, i in sorted(of):
            assert offset == len(tokens)
            tokens += docs[i][3]
            rope += [x + cursor for x in docs[i][4]]
            cursor = (max(rope[offset:]) // stride + 1) * stride
        used = len(tokens)
        want[at] = (len(of), used, tokens + [-7] * (capacity - used), rope + [cursor + k if count_on else 0 for k in range(capacity - used)])
    assert {(r.shard, r.row): (r.docs, r.used, list(r.token), list(r.rope)) for r in got.collect()} == want
    assert packing.assemble_rows(packed.limit(0), df, capacity, "shard", "doc_id", {"token": 0}, rope=None).count() == 0


IDS = {n: 90 + i for i, n in enumerate(("user_start", "user_end", "assistant_start", "assistant_end"))}
NEWLINE = 77


def test_turn_documents(spark):
    """The prompt whole, a block for each newline token, and a newline without a mask after the mark that ends the turn."""
    pairs = spark.createDataFrame([(1, 0, "1 2", "3\n\n4 5"), (2, 0, "6", "7"), (3, 0, None, None)], "conv_id int, pair int, prompt string, reply string")
    ids = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: x.cast("int"))
    docs = layout.assign_roles(chat.turn_documents(pairs, ids, IDS, NEWLINE), 16)
    got = {r.conv_id: r for r in docs.collect()}
    assert got[1].blocks == [[90, 1, 2, 91], [92, 3, 77], [77], [4, 5, 93, 77]] and got[1].mask == [[0, 0, 0, 0], [0, 1, 1], [1], [1, 1, 1, 0]]
    assert got[2].blocks == [[90, 6, 91], [92, 7, 93, 77]] and got[3].blocks == [[90, 91], [92, 93, 77]] and got[3].mask == [[0, 0], [0, 1, 0]]
    rows = layout.rows(docs, "conv_id", ids=layout.Ids(bos=50, sot=51, eot=52, sot_tail=53), payloads=("mask",))
    row = {r.conv_id: r for r in chat.masked_rows(rows).collect()}[2]
    assert row.token == [50, 90, 6, 91, 51, 53, 92, 7, 93, 77] and row.target == [90, -1, -1, -1, 53, -1, -1, 93, 77, -1]
    flags = chat.forced_flags(layout.positions(docs.where("conv_id = 2"), "conv_id", payloads=("mask",))).orderBy("row_pos").collect()
    assert [r.forced for r in flags] == [True] * 7 + [False, False, True]


def test_contents_and_quarantine(spark):
    rows = [
        (1, 0, "user", '"hi"'), (1, 1, "assistant", '[{"type": "text", "text": "a"}, {"type": "python", "text": "b"}]'),
        (2, 0, "user", '[{"type": "text", "text": "a"}]'), (2, 1, "assistant", '"x"'),
        (3, 0, "user", '"q"'), (3, 1, "assistant", '[{"type": "image", "text": "a"}]'),
        (4, 0, "user", '"q"'), (4, 1, "tool", '"a"'), (4, 2, "assistant", "7"),
        (5, 0, "user", '"q"'), (5, 1, "assistant", "7"), (6, 0, "user", "null"), (7, 0, "user", None),
        (8, 0, "user", '"q"'), (8, 1, "assistant", '[{"type": "text"}]'), (9, 0, "user", '"q"'), (9, 1, "assistant", "[]"),
        (10, 0, "user", '"q"'), (10, 1, "assistant", '["bare"]'), (11, 0, "system", '"s"'), (11, 1, "assistant", '"a"'), (None, 0, "user", '"q"'),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, json string").withColumn("content", F.parse_json("json"))
    turns = chat.read_content(df)
    good, bad = chat.quarantine(turns)
    assert {r.conv_id for r in good.collect()} == {1, 9, None}
    assert {r.conv_id: r.reason for r in bad.collect()} == {
        2: "parts in a user turn", 3: "unknown part type", 4: "roles do not alternate", 5: "content of another kind", 6: "no content", 7: "no content",
        8: "part without text", 10: "unknown part type", 11: "roles do not alternate",
    }
    assert [(p.type, p.text) for p in turns.where("conv_id = 1 and turn = 1").first().parts] == [("text", "a"), ("python", "b")]
    assert chat.quarantine(turns.limit(0))[0].count() == 0


def test_another_role_is_never_supervised(spark):
    df = spark.createDataFrame([([("tool", "x")],)], "messages array<struct<role:string,text:string>>")
    ids = {k: i for i, k in enumerate(chat.MARKS)}
    with pytest.raises(Exception, match="another role"):
        df.select(chat.render(F.col("messages"), lambda c: F.transform(F.split(c, " "), F.length), ids)).collect()
