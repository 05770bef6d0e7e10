"""Operators that SQL cannot express, against plain Python, and sources and sinks."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from linepack.operators import chat, longlines, logs, metrics, packing, prompts, tokens
from linepack.sources import corpus, items
from linepack.streaming.ingest import ingest, stream_corpus


def slow_split(text, budget, most):
    n = lambda s: len(s.split(" "))
    if len(text.encode()) + budget <= most or n(text) + budget <= most or len(text) < 2:
        return [text]
    mid, half = len(text) // 2, max(1, int(len(text) * 0.25))
    ends = [m.end() for m in re.finditer(r"[.!?;。！？；…]", text[max(0, mid - half) : min(len(text), mid + half)])]
    cut = max(0, mid - half) + ends[-1] if ends else mid
    cut = mid if cut in (0, len(text)) else cut
    return slow_split(text[:cut], 1, most) + slow_split(text[cut:], budget, most)


def test_long_lines(spark):
    rnd = random.Random(1)
    line = lambda: " ".join(rnd.choice(["aa", "b.", "cc!", "中文。", "d"]) for _ in range(rnd.randrange(1, 120)))
    texts = ["".join(line() + rnd.choice(["\n", "\n\n", "\r\n"]) for _ in range(rnd.randrange(1, 5))) + line() for _ in range(20)] + ["", "\n\nx", "a" + "\n" * 40, None, "short"]
    got = {r.doc_id: r.text for r in longlines.split_long_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 20).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        t = re.sub(r"([\n\r]{16})[\n\r]+", r"\1", t.lstrip("\n\r"))
        parts = re.split(r"([\n\r]+)", t)
        want = ""
        for k in range(0, len(parts), 2):
            sep = parts[k + 1] if k + 1 < len(parts) else ""
            over = len((parts[k] + sep).encode()) > 20 and len(parts[k].split(" ")) + len(sep) > 20
            want += ("\n".join(slow_split(parts[k], max(1, len(sep)), 20)) if over else parts[k]) + sep
        assert got[i] == want


def test_bpe_equals_one_merge_at_a_time(spark):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 9))): rnd.randrange(1, 50) for _ in range(150)} | {"aaaa": 40, "aaa": 11}
    merges = tokens.train_bpe(spark.createDataFrame(list(words.items()), "word string, n long"), 70, cut_every=3)
    state = [(list(w.encode()), n) for w, n in words.items()]
    for new, (a, b, got) in zip(range(256, 326), merges):
        count = {}
        for s, n in state:
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + n
        assert got == new and (a, b) == min(count, key=lambda p: (-count[p], p))
        for s, _ in state:
            k = 0
            while k + 1 < len(s):
                if (s[k], s[k + 1]) == (a, b):
                    s[k : k + 2] = [new]
                k += 1
    docs = spark.createDataFrame([(1, "aabb cdé 12345\n\n x's"), (2, ""), (3, "aaaa")], "doc_id int, text string")
    ids = tokens.encode(docs, tokens.pretokenize(F.col("text")), merges, first=999)
    back = {r.doc_id: r.decoded for r in tokens.decode(ids, merges).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert tokens.encode(docs, tokens.pretokenize(F.col("text")), merges, first=999, backwards=True).where("ids[0] <> 999").isEmpty()


def test_check_vocab(spark):
    good = spark.createDataFrame([(0, "a", False), (1, "\n", False), (2, "a\n\n", False)], "id int, token string, is_special boolean")
    tokens.check_vocab(good)
    with pytest.raises(ValueError):
        tokens.check_vocab(good.union(spark.createDataFrame([(3, " \n \n", False)], good.schema)))
    with pytest.raises(ValueError):
        tokens.check_vocab(good.where("id = 0"))


def slow_pack(lengths, capacity, buffer, crop):
    lengths, held, rows = [x for x in enumerate(lengths) if crop or x[1] <= capacity], [], [[]]
    room = capacity
    while lengths or held:
        while lengths and len(held) < buffer:
            held.append(lengths.pop(0))
        fit = [x for x in held if x[1] <= room]
        if fit:
            pick = max(fit, key=lambda x: (x[1], -x[0]))
        elif crop:
            pick = min(held, key=lambda x: (x[1], x[0]))
        else:
            rows, room = rows + [[]], capacity
            continue
        held.remove(pick)
        rows[-1].append((pick[0], min(pick[1], room)))
        room -= min(pick[1], room)
        if not room:
            rows, room = rows + [[]], capacity
    return [r for r in rows if r]


@pytest.mark.parametrize("crop", [True, False])
def test_packing_equals_lists(spark, crop):
    rnd = random.Random(3)
    shards = {s: [rnd.randrange(1, 60) for _ in range(80)] for s in ("a", "b", "c")}
    df = spark.createDataFrame([(s, i, n) for s, v in shards.items() for i, n in enumerate(v)], "shard string, doc_id int, length int")
    out = (packing.pack_crop if crop else packing.pack_whole)(df.repartition(5), 49, "shard", buffer=12)
    capacity = 50 if crop else 49
    got = {}
    for r in out.orderBy("shard", "row", "part").collect():
        got.setdefault(r.shard, {}).setdefault(r.row, []).append((r.doc_id, r.used))
    for s, v in shards.items():
        assert [x for _, x in sorted(got[s].items())] == slow_pack(v, capacity, 12, crop)
    if crop:
        full = packing.full_rows(out, capacity, "shard").groupBy("shard", "row").agg(F.sum("used").alias("n"))
        assert {r.n for r in full.collect()} == {capacity}


def test_fewshot_contract(spark):
    df = spark.createDataFrame([("t", i) for i in range(23)] + [("u", i) for i in range(4)], "task string, item int")
    rows = prompts.fewshot(df, "task", "item", 5).collect()
    by = {}
    for r in rows:
        by.setdefault((r.task, r.item), []).append(r.shot)
    assert set(by) == {("t", i) for i in range(23)}
    assert all(len(set(x)) == 5 and k[1] not in x for k, x in by.items())
    assert rows == prompts.fewshot(df.repartition(7), "task", "item", 5).collect() or sorted(rows) == sorted(prompts.fewshot(df.repartition(7), "task", "item", 5).collect())


def test_prompts_with_shots(spark):
    row = spark.createDataFrame([("q", ["a", "bb"], [(0, "q1", "x"), (1, "q2\nz", "y")])], "query string, choices array<string>, shots array<struct<j:int,query:string,answer:string>>")
    r = row.select(prompts.render_choices(F.col("query"), F.col("choices"), F.col("shots"), " ").alias("m"), prompts.render_choices(F.col("query"), F.col("choices"), F.col("shots"), "\n", "one_line").alias("o"), prompts.render_lm(F.lit(" c "), F.lit("d"), F.col("shots"), " ").alias("l")).first()
    assert r.m == ["q1 x\n\nq2\nz y\n\nq a", "q1 x\n\nq2\nz y\n\nq bb"]
    assert r.o == ["q1 x\nq2 z y\nq a", "q1 x\nq2 z y\nq bb"]
    assert r.l == ["q1 x\n\nq2\nz y\n\nc", "q1 x\n\nq2\nz y\n\nc d"]


@pytest.mark.parametrize(("beta", "n"), [(0.9, 300), (0.5, 900), (0.1, 400), (0.999, 3000)])
def test_ema(spark, beta, n):
    rnd = random.Random(4)
    v = [rnd.random() for _ in range(n)]
    got = [r.ema for r in logs.ema(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "run int, step int, x double"), "run", "step", "x", beta).orderBy("step").collect()]
    m = 0.0
    for i, x in enumerate(v):
        m = beta * m + (1 - beta) * x
        assert got[i] == pytest.approx(m / (1 - beta ** (i + 1)), rel=1e-9)


def test_parts_of_unknown_type_are_an_error(spark):
    one = "array(named_struct('role', 'assistant', 'text', 'x', 'parts', array(named_struct('type', 'image', 'text', 'y'))))"
    ids = {k: i for i, k in enumerate(chat.MARKS)}
    df = spark.sql(f"select {one} as m").select(chat.render(F.col("m"), lambda c: F.transform(F.split(c, " "), lambda x: F.length(x)), ids, None, parts=True).alias("r"))
    with pytest.raises(Exception, match="unknown part type: image"):
        df.collect()


def test_corpus_files(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    for k in range(3):
        spark.createDataFrame([(f"doc {k} {i}\n",) for i in range(4)], "text string").coalesce(1).write.parquet(f"{root}/tmp{k}")
        part = next((tmp_path / "c" / f"tmp{k}").glob("part-*"))
        part.rename(tmp_path / "c" / f"shard_{k}.parquet")
    spec = corpus.CorpusSpec(root)
    assert corpus.read_corpus(spark, spec, "train").count() == 8
    assert {r.shard for r in corpus.read_corpus(spark, spec, "val").collect()} == {"shard_2.parquet"}
    assert corpus.read_corpus(spark, corpus.CorpusSpec(root, "shard_0", "shard_1"), "val").count() == 4
    docs = corpus.read_corpus(spark, spec, "train").withColumn("id", F.concat("shard", F.col("ordinal").cast("string")))
    fix = lambda d: d.withColumn("text", F.replace("text", F.lit("doc 0"), F.lit("new")))
    first = {r.shard: (r.docs, r.modified) for r in corpus.rewrite_shards(spark, docs, "shard", f"file://{tmp_path}/out", fix, "id").collect()}
    assert first == {"shard_0.parquet": (4, 4), "shard_1.parquet": (4, 0)}
    assert corpus.rewrite_shards(spark, docs, "shard", f"file://{tmp_path}/out", fix, "id").collect() == []


def test_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    src, out, cp = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    for k in range(2):
        spark.createDataFrame([(f"\n\ntext {k}",), ("  ",), (None,)], "text string").coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):
            ingest(stream_corpus(spark, src), out, cp).awaitTermination()
        assert sorted(r.text for r in spark.read.parquet(out).collect()) == [f"text {i}" for i in range(k + 1)]


def test_items_scores_metrics(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text("\n".join(["", json.dumps({"query": "q", "choices": ["a", "b"], "gold": 1}), "  ", json.dumps({"context": "c", "continuation": "d"})]))
    rows = items.read_items(spark, f"file://{tmp_path}/items.jsonl").orderBy("line").collect()
    assert [(r.line, r.query, r.context) for r in rows] == [(2, "q", None), (4, None, "c")]
    (tmp_path / "b.csv").write_text("label,random_baseline\nx,25.0\n")
    assert items.read_baselines(spark, f"file://{tmp_path}/b.csv").first().random_baseline == 25.0
    scores = spark.createDataFrame([("x", 0.5, 0.25), ("y", 0.7, 0.35)], "task string, accuracy double, centered double")
    path = items.write_scores(scores, f"file://{tmp_path}/s", "run1")
    assert [r.task for r in spark.read.option("header", True).csv(path).collect()] == ["x", "y", "CORE"]
    m = spark.createDataFrame([("r", "s", "l", "bpb", 0.5)], "run string, slice string, label string, metric string, value double")
    items.write_metrics(m, f"file://{tmp_path}/m")
    assert items.read_metrics(spark, f"file://{tmp_path}/m").collect() == m.collect()


def test_fewshot_pool(spark):
    """Shots come from the pool only; items outside it get some too, and items inside it never themselves."""
    df = spark.createDataFrame([("t", i, i % 3 == 0) for i in range(30)] + [("u", i, i < 2) for i in range(9)] + [("v", 1, None)], "task string, item int, good boolean")
    by = {}
    for r in prompts.fewshot(df, "task", "item", 2, pool="good").collect():
        by.setdefault((r.task, r.item), set()).add(r.shot)
    assert {k for k in by if k[0] == "t"} == {("t", i) for i in range(30)} and all(len(x) == 2 and k[1] not in x for k, x in by.items())
    assert all(s % 3 == 0 for k, x in by.items() if k[0] == "t" for s in x)
    assert {k for k in by if k[0] == "u"} == {("u", i) for i in range(2, 9)}  # a pool of two is too small for its own items


def test_joined_history_takes_each_pair_once(spark):
    from linepack.functions import text as T

    head, tail = "story\n\nPreceding questions:\n", "\nFinal question:\nQuestion: last\nAnswer: "
    bodies = ["Question: a\nAnswer: b\nQuestion: c\nAnswer: d\n", "Question: a\nAnswer: b Question: c\nAnswer: d\n", "Question: a\nAnswer: b Question: c\nAnswer: d Question: e\nAnswer: f\n", "x Question: a\nAnswer: b\n\n", "Answer: a\nAnswer: b\n", "\n"]

    def plain(text):
        text = re.sub(r"(Preceding questions:\n)(.*?\n)(\nFinal question:\n)", lambda m: m[1] + re.sub(r"(Question: [^\n]*)\n(Answer: [^\n]*)\n", r"\1 \2\n", m[2]) + m[3], text, flags=re.S)
        return re.sub(r"\nFinal question:\nQuestion: ([^\n]*)\nAnswer: \Z", r"\nFinal question: Question: \1 Answer: ", text)

    texts = [head + b + tail for b in bodies] + ["no headings", head, tail]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.j for r in df.select("i", T.joined_history(F.col("t")).alias("j")).orderBy("i").collect()] == [plain(t) for t in texts]


def test_overall_flag(spark):
    rows = spark.createDataFrame([("a", "OK"), ("b", "?"), ("c", "GAP")], "run string, flag string")
    assert [metrics.overall(rows.where(c)).first().flag for c in ("true", "run <> 'c'", "run = 'a'", "false")] == ["GAP", "?", "OK", "OK"]
